"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors collapse into one class first. Every tree splits its nodes at the median of a
random projection, one for each tree and level, until a node has at most `leaf` classes; a
class closer to the median than half the link distance goes to both sides (spill). A larger
node that lies so close together that such a split would leave most of it on one side (a
family of near copies) is not split: it is dealt into blocks and all pairs of blocks are
compared, so that no partner is lost however large the family is.

Classes that share a leaf in any tree are compared exactly; each pair counts in the first
leaf that has both, so that tasks return one row a class and no table of pairs exists. Trees
grow level by level: one aggregation gives the sizes and medians of all nodes of all trees,
so that no node is ever collected before it is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPILL = 0.1  # half the largest distance of two unit vectors that link, in projection units
SHARE = 0.7  # a node is split only where each side gets at most this share of it
BLOCK = 256  # classes of one block of a node that is not split


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in a list column: the rows that have it, and their values."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(offsets)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, values[offsets[:-1][at][:, None] + np.arange(n)]


def _project(trees: int, levels: int):
    """Map function over (id, label, v): the projections of each class for all levels of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _vectors(batch.column(2)) if batch.num_rows else ():
                unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
                rows = pa.array(at)
                for tree in range(trees):
                    p = (unit @ np.random.default_rng((tree, v.shape[1])).normal(size=(v.shape[1], levels))).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, levels, dtype=np.int32)), pa.array(p.ravel()))
                    of = [pa.array(np.full(len(at), x, dtype=np.int32)) for x in (tree, v.shape[1])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *of, lists], names=["id", "label", "tree", "dim", "p"])

    return run


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each row of a links with each row of b, those near the limit by an exact sum."""
    norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    dots = a @ b.T
    out = dots > (cosine + 1e-9) * norms
    x, y = np.nonzero(np.abs(dots - cosine * norms) <= 1e-9 * norms)
    out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) / norms[x, y] >= cosine
    return out


def _met(nodes: np.ndarray, node: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share a leaf before this one; nodes: the leaves of each row, padded with the largest number."""
    out = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 4096):
        a, b = nodes[i[at : at + 4096]], nodes[j[at : at + 4096]]
        out[at : at + 4096] = ((a[:, :, None] == b[:, None, :]) & (a < node)[:, :, None]).any(axis=(1, 2))
    return out


def _heads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first row that each row is connected with by the pairs."""
    head = np.arange(n)
    while True:
        before = head.copy()
        np.minimum.at(head, i, head[j])
        np.minimum.at(head, j, head[i])
        head = head[head]
        if (head == before).all():
            return head


def _compare(cosine: float):
    """Map function over (group, node, lo, hi, block, id, v, m, nodes), sorted by group: links within a leaf or between two of its blocks.

    Gives for each class that links the rows it meets here first, and a class that it is connected with.
    """

    def links(rows: pa.RecordBatch) -> pa.RecordBatch:
        node, lo, hi = (rows.column(k)[0].as_py() for k in (1, 2, 3))
        block, ids, m = (rows.column(k).to_numpy() for k in (4, 5, 7))
        _, v = next(_vectors(rows.column(6)))
        if lo == hi:
            i, j = np.nonzero(np.triu(_near(v, v, cosine), 1))
        else:
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            i, j = np.nonzero(_near(v[left], v[right], cosine))
            i, j = left[i], right[j]
        if len(i):
            lists = rows.column(8)
            size = np.diff(lists.offsets.to_numpy())
            nodes = np.full((len(ids), size.max()), np.iinfo(np.int64).max)
            nodes[np.arange(size.max()) < size[:, None]] = lists.flatten().to_numpy()
            new = ~_met(nodes, node, i, j)
            i, j = i[new], j[new]
        count = np.bincount(i, weights=m[j], minlength=len(ids)) + np.bincount(j, weights=m[i], minlength=len(ids))
        keep = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[keep], count[keep].astype(np.int64), ids[_heads(len(ids), i, j)][keep])], names=["id", "links", "head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.whole_groups(batches):
            group = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for a, b in zip(first, np.append(first[1:], len(group)), strict=True):
                if b - a > 1:
                    yield links(batch.slice(a, b - a))

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, trees: int = 6, leaf: int = 64, levels: int = 40, scratch: C.Scratch | None = None) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept.

    vectors needs vec_id (integer), embedding (array of float or double) and label. Two rows
    with one label link when the cosine of their vectors, in double precision, is at least
    `cosine`; n_links counts the other rows linked directly and component_id is the smallest
    vec_id reachable. Every pair found is a true link; the trees miss few (recall is measured
    in the tests). A family of near copies too close to be split is compared whole, as is a
    node that is still large after `levels` levels.

    A vector that is null, empty, zero or has a null or non-finite component, a null label or
    a null vec_id: no links, component_id is its own vec_id. Vectors are divided by their
    largest component first, so that squares neither overflow nor vanish. Vectors of different
    lengths do not link. Repeated rows are vectors of their own and link with each other. Empty
    table: no rows. Other columns are not read.
    """
    s = scratch or C.Scratch(vectors.sparkSession, "forest")
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.array_max(F.transform(v, F.abs))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (largest > 0), F.lit(False))
    # a value times a power of two is exact, so vectors that are each other's multiples by one become equal
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(usable, C.let(largest, lambda top: F.transform(v, lambda x: x / top))).alias("v"))
    rows = s.save(rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v", "label"))))
    live = rows.where("v is not null")
    key = ["h1", "h2"]  # 128 bits of label and direction
    classes = live.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = s.save(classes.withColumn("id", F.monotonically_increasing_id()))

    at = classes.select("id", "label", "v").mapInArrow(_project(trees, levels), "id bigint, label string, tree int, dim int, p array<float>")
    at = at.select("id", F.xxhash64("tree", "label", "dim").alias("node"), "p")
    leaves = None
    for level in range(levels + 1):
        at = s.save(at)
        value = F.get("p", F.lit(0))
        q = F.percentile_approx(value, F.array(F.lit(1 - SHARE), F.lit(0.5), F.lit(SHARE)), 1000)
        nodes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *([q.alias("q")] if level < levels else []))
        wide = (F.col("q")[0] <= F.col("q")[1] - SPILL) & (F.col("q")[2] > F.col("q")[1] + SPILL) & (F.col("n") > leaf) if level < levels else F.lit(False)
        nodes = s.save(nodes.select("node", "n", F.coalesce(wide, F.lit(False)).alias("wide"), (F.col("q")[1] if level < levels else F.lit(0.0)).alias("mid")))
        known = C.salted_join(at, nodes, ["node"], "n", F.col("id"))
        ended = known.where("not wide").select("id", "node", F.when(F.col("n") <= leaf, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"))
        leaves = ended if leaves is None else leaves.union(ended)
        if not nodes.where("wide").limit(1).count():
            break
        sides = F.array_compact(F.array(F.when(value <= F.col("mid") + SPILL, F.lit(0)), F.when(value > F.col("mid") - SPILL, F.lit(1))))
        at = known.where("wide").select("id", F.explode(sides).alias("side"), "node", "p").select("id", F.xxhash64("node", "side").alias("node"), F.expr("slice(p, 2, size(p))").alias("p"))

    leaves = s.save(leaves)
    lists = leaves.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = leaves.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).withColumn("group", F.xxhash64("node", "lo", "hi"))
    full = dealt.join(classes.select("id", "v", "m").join(lists, "id"), "id").select("group", "node", "lo", "hi", "block", "id", "v", "m", "nodes")
    found = s.save(full.repartition("group").sortWithinPartitions("group").mapInArrow(_compare(cosine), "id bigint, links bigint, head bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # components by the smallest vec_id of each class; a vec_id in several classes links them
    names = classes.select("id", "least")
    hi, lo = names.toDF("id", "x"), names.toDF("head", "y")
    edges = found.where("id <> head").select("id", "head").distinct().join(hi, "id").join(lo, "head").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
    several = live.groupBy("vec_id").agg(F.count_distinct(*key).alias("n")).where("n > 1").select("vec_id")
    own = live.join(several, "vec_id", "left_semi").join(classes.select(*key, "least"), key).where("vec_id > least").select(F.col("vec_id").alias("hi"), F.col("least").alias("lo"))
    comp = C.connected_components(edges.where("hi > lo").union(own), s)

    known = classes.join(links, "id", "left").join(comp, classes["least"] == comp["node"], "left")
    known = s.save(known.select(*key, "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")))
    linked = C.salted_join(live.select("vec_id", *key), known, key, "m", F.xxhash64("vec_id")).select("vec_id", "n_links", "component_id")
    out = linked.union(rows.where("v is null").select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
