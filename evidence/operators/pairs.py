"""Candidate pairs of statements by similarity within a block, and what becomes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

YEAR = r"\b(19[5-9]\d|20[0-4]\d)\b"

from ..sources.files import saved
from .indexes import ranked

#: Files of packed chunks at least; Spark reads small ones together.
TASKS = 32


def extract_year(text: Column) -> Column:
    """The first year from 1950 to 2049 in a text; null for none, an empty text or NEURČENO."""
    year = F.regexp_extract(text, YEAR, 1)
    return F.when((year != "") & (text != "NEURČENO"), year.cast("int"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in their order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; zero vectors stay zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def packed_chunks(claims: DataFrame, block: str, item: str, vector: str, year: str, chunk: int) -> DataFrame:
    """Claims of each block in chunks of about `chunk`, one row a chunk: block, own, chunks and arrays of items, years and one of all numbers.

    A chunk is found by a hash of the item. Null vectors and nulls in a vector count as 0.0, and a shorter vector is filled up.
    Floats stay floats here; products are taken in double precision.
    """
    number = "float" if claims.schema[vector].dataType.elementType.typeName() == "float" else "double"
    size = claims.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("width"))
    cut = claims.join(size, block).withColumn("own", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
    at = F.sequence(F.lit(0), F.col("width") - 1)
    numbers = F.when(F.col("width") > 0, F.transform(at, lambda i: F.coalesce(F.get(F.col(vector), i).cast(number), F.lit(0.0).cast(number)))).otherwise(F.array().cast(f"array<{number}>"))
    row = F.struct(F.col(item).alias("item"), F.col(year).cast("int").alias("year"), numbers.alias("v"))
    packed = cut.groupBy(block, "own", "chunks").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # as many rows as a chunk holds
    return packed.select(block, "own", "chunks", F.col("rows.item").alias("items"), F.col("rows.year").alias("years"), F.flatten("rows.v").alias("numbers"))


def _products(k: int, penalty: float, out_type: pa.DataType):
    """Map function over (block, same, items, years, numbers of two chunks): the k best others of each item, in both directions."""

    def best(score: np.ndarray, conflict: np.ndarray, mine: pa.Array, others: pa.Array, own: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        # others come in ascending order, so a stable sort gives ties to the smaller id
        if own:
            names = mine.to_numpy(zero_copy_only=False)
            score[names[:, None] == names[None, :]] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(order)), order.shape[1])
        column = order.ravel()
        found = score[row, column]
        use = found > -np.inf
        row, column = row[use], column[use]
        return mine.take(pa.array(row)), others.take(pa.array(column)), found[use], conflict[row, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell = lambda name, at=at, batch=batch: batch.column(batch.schema.get_field_index(name))[at].values
                a, b = cell("items"), cell("items_b")
                x, y = (cell(n).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(i), -1) for n, i in (("numbers", a), ("numbers_b", b)))
                years = [cell(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("years", "years_b")]
                score = np.zeros((len(a), len(b)))
                for d in range(x.shape[1]):  # the order of the sum is that of the vectors, so equal vectors have equal scores
                    score += x[:, d, None] * y[None, :, d]
                known = ~np.isnan(years[0])[:, None] & ~np.isnan(years[1])[None, :]
                conflict = known & (years[0][:, None] != years[1][None, :])
                score = np.where(conflict, np.maximum(0.0, score - penalty), score)
                same = batch.column(batch.schema.get_field_index("same"))[at].as_py()
                parts = [best(score, conflict, a, b, same)] + ([] if same else [best(score.T, conflict.T, b, a, False)])
                block = pa.repeat(batch.column(0)[at], sum(len(p[0]) for p in parts))
                yield pa.RecordBatch.from_arrays(
                    [block, pa.concat_arrays([p[0] for p in parts]).cast(out_type), pa.concat_arrays([p[1] for p in parts]).cast(out_type), pa.array(np.concatenate([p[2] for p in parts])), pa.array(np.concatenate([p[3] for p in parts]))],
                    names=["block", "item", "other", "score", "conflict"],
                )

    return run


def topk_similar(claims: DataFrame, block: str, item: str, vector: str, year: str, k: int = 5, penalty: float = 0.10, chunk: int = 256) -> DataFrame:
    """The k most similar other items of each item's block: block, item, other, score, conflict, rank.

    score is the inner product of unit vectors; different years (both known) cost the penalty, at
    least 0 is left, and conflict says so. Ties go to the smaller id. Rows with one item are never compared;
    a null block or item is left out.

    A block of n items is n / chunk packed rows, written once; a task reads two sets of them and multiplies the chunks of one
    block, which serves both directions, and keeps k others of each item. No copies of chunks are shuffled; what is merged is k rows an item and task.
    """
    known = claims.where(F.col(block).isNotNull() & F.col(item).isNotNull())
    packed = saved(packed_chunks(known.select(block, item, vector, year), block, item, vector, year, chunk).repartition(TASKS), "chunks")
    columns = ["items", "years", "numbers"]
    # of two chunks the pair (i, j) with i <= j is formed
    left = packed.select(F.col(block).alias("block"), F.col("own").alias("i"), *columns)
    right = packed.select(F.col(block).alias("block_b"), F.col("own").alias("j"), *[F.col(c).alias(f"{c}_b") for c in columns])
    meet = left.hint("shuffle_replicate_nl").join(right, (F.col("block") == F.col("block_b")) & (F.col("i") <= F.col("j")))
    pairs = meet.select("block", (F.col("i") == F.col("j")).alias("same"), *columns, *[f"{c}_b" for c in columns])
    kinds = {c: claims.schema[c].dataType for c in (block, item)}
    schema = f"block {kinds[block].simpleString()}, item {kinds[item].simpleString()}, other {kinds[item].simpleString()}, score double, conflict boolean"
    found = pairs.mapInArrow(_products(k, penalty, to_arrow_type(kinds[item])), schema).select(F.col("block").alias(block), F.col("item").alias(item), "other", "score", "conflict")
    w = Window.partitionBy(block, item).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_dedupe(pairs: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """Each unordered pair once, in the direction that comes first."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest_reference(turns: DataFrame, references: DataFrame, label: str, length: str, seq: str, vector: str, ref: str, n: int = 3, most: float = 20.0, least: float = 1.0, pivots: int = 16, ring: float = 0.125) -> DataFrame:
    """For each label's longest turn (ties: the first), cut to `most`, the n nearest references by cosine (ties: the smaller).

    Turns shorter than `least` are skipped; a zero vector has cosine 0.

    Some references, at most `pivots`, are centres; each other one is filed under its nearest centre and its distance from
    it, in rings. By the triangle inequality a label asks only the rings that can hold one of its n nearest: n
    references lie within the sum of its distance to the nearest centres and those cells' radius, which bounds the search.
    """
    longest = turns.groupBy(label).agg(F.max_by(F.struct(vector, length), F.struct(length, (-F.col(seq)).alias("s"))).alias("t"))
    v = F.col(f"t.{vector}")
    asked = longest.where(F.col(f"t.{length}") >= least).select(label, v.alias("v"), F.least(F.lit(most), F.col(f"t.{length}")).alias("clip"), unit(v).alias("u"), (dot(v, v) > 0).alias("some"))
    r = F.col("r")
    known = references.select(F.col(ref).alias("ref"), F.col(vector).alias("r")).withColumn("ru", unit(r)).withColumn("r_some", dot(r, r) > 0)
    live = known.where("r_some")
    apart = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(a, b)))
    # one row: at most `pivots` centres
    centres = live.orderBy(F.xxhash64("ref"), "ref").limit(pivots).agg(F.collect_list(F.struct(F.col("ref").alias("p"), F.col("ru").alias("c"))).alias("centres"))
    filed = live.crossJoin(F.broadcast(centres)).withColumn("near", F.array_min(F.transform("centres", lambda x: F.struct(apart(F.col("ru"), x["c"]).alias("d"), x["p"].alias("p")))))
    filed = filed.select("ref", "r", F.col("near.p").alias("p"), F.col("near.d").alias("d"), F.floor(F.col("near.d") / ring).alias("ring"))
    cells = filed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).agg(F.collect_list(F.struct("p", "n", "radius")).alias("cells"))
    table = centres.crossJoin(cells).select(F.transform("cells", lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n"), x["radius"].alias("radius"), F.filter("centres", lambda c: c["p"] == x["p"])[0]["c"].alias("c"))).alias("cells"))
    far = asked.where("some").crossJoin(F.broadcast(table)).withColumn("cells", F.transform("cells", lambda x: F.struct((apart(F.col("u"), x["c"]) + x["radius"]).alias("up"), x["n"].alias("n"), apart(F.col("u"), x["c"]).alias("far"), x["p"].alias("p"), x["radius"].alias("radius"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(2.0).alias("up"))
    bound = F.aggregate(F.array_sort("cells"), start, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["n"] < n, x["up"]).otherwise(a["up"]).alias("up")), lambda a: F.when(a["n"] < n, F.lit(4.0)).otherwise(a["up"]))
    slack = 1e-6  # distances are rounded
    far = far.withColumn("bound", bound + slack).select(label, "v", "clip", "bound", F.explode("cells").alias("x")).where(F.col("x.far") - F.col("x.radius") <= F.col("bound"))
    rings = F.sequence(F.floor(F.greatest(F.lit(0.0), F.col("x.far") - F.col("bound")) / ring), F.floor(F.least(F.col("x.radius"), F.col("x.far") + F.col("bound")) / ring))
    wanted = far.select(label, "v", "clip", "bound", F.col("x.p").alias("p"), F.col("x.far").alias("far"), F.explode(rings).alias("ring"))
    met = wanted.join(filed, ["p", "ring"]).where(F.abs(F.col("far") - F.col("d")) <= F.col("bound"))
    scored = met.select(label, "clip", "ref", (dot(F.col("v"), F.col("r")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("r"), F.col("r"))))).alias("cosine"))
    # cosine 0 by definition: zero references for every label, all references for a label without a direction; n of them are enough
    first = lambda rows: F.broadcast(rows.orderBy("ref").limit(n).select("ref"))
    zeros = asked.where("some").crossJoin(first(known.where("not r_some"))).union(asked.where("not some").crossJoin(first(known)))
    every = scored.unionByName(zeros.select(label, "clip", "ref", F.lit(0.0).alias("cosine")))
    w = Window.partitionBy(label).orderBy(F.desc("cosine"), "ref")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topn_candidates(pairs: DataFrame, score: str, tie: str, a: str, b: str, n: int) -> DataFrame:
    """The 5n best pairs, each unordered pair of messages once, then the 3n best of them."""
    best = pairs.orderBy(F.desc(score), tie).limit(5 * n)
    return pair_dedupe(best, a, b, [F.desc(score), F.col(tie)]).orderBy(F.desc(score), tie).limit(3 * n)


def balanced_sample(rows: DataFrame, positive: Column, key: Column, seed: int = 42, factor: int = 2, least: int = 50) -> DataFrame:
    """All positives, and of the negatives the first max(factor * positives, least) by a seeded hash of the key."""
    order = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    wanted = rows.agg(F.greatest(F.lit(factor) * F.count_if(positive), F.lit(least)).alias("_most"))  # one row
    placed = ranked(rows.where(~positive).withColumn("_o", order), [*rows.columns, "_o"], [F.asc("_o")])
    chosen = placed.crossJoin(F.broadcast(wanted)).where(F.col("place") <= F.col("_most")).select(*rows.columns)
    return rows.where(positive).unionByName(chosen)


def recall_at_k(found: DataFrame, expected: DataFrame, item: str, block: str, blocks: DataFrame) -> DataFrame:
    """Queries, how many found the expected item, their share, and candidates of another block (must be 0)."""
    hits = expected.join(found.select(item, "other"), (expected[item] == found[item]) & (expected["expected"] == found["other"]), "left_semi")
    leak = found.join(blocks.select(F.col(item).alias("other"), F.col(block).alias("_b")), "other").agg(F.count_if(F.col("_b") != F.col(block)).alias("leaks"))
    counts = expected.agg(F.count(F.lit(1)).alias("queries")).crossJoin(hits.agg(F.count(F.lit(1)).alias("hits")))
    return counts.crossJoin(leak).withColumn("recall", F.round(F.col("hits") / F.col("queries"), 6))


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[tuple[float, float, float]]], a: str, b: str, batch: int = 32) -> DataFrame:
    """Pairs with entailment, neutral, contradiction by a pluggable scorer, called on `batch` pairs at a time."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), batch):
                out += scorer(f[a].iloc[at : at + batch].tolist(), f[b].iloc[at : at + batch].tolist())
            yield f.assign(**{name: [x[i] for x in out] for i, name in enumerate(("entailment", "neutral", "contradiction"))})

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, entailment double, neutral double, contradiction double")


def embed_texts(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str, name: str = "vector") -> DataFrame:
    """Rows with a unit vector of their text by a pluggable encoder; a null text is encoded as empty."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{name: encoder([x if isinstance(x, str) else "" for x in f[text]])})

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return rows.mapInPandas(run, f"{schema}, `{name}` array<double>").withColumn(name, unit(F.col(name)))
