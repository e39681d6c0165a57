"""From packed b-bit signatures of distinct sets to verified components.

A signature keeps the low 8 bits of each minimum; the bits of `rows` neighbours are a band key.

Which keys are shared is found without a row a key: a task sends its keys as sorted packed
runs, each key at most twice, and one group of a range of keys looks for equals in them.

How groups stay small in every task: a bucket (the sets with one band key) first offers each
member only its most connected member, the hub, so that a family of copies costs one test a
copy. After those links are joined into components, only pairs across components are left.
Their signatures are compared inside tasks, a bucket at a time and a large bucket in blocks;
what comes out are the pairs that pass the estimate, each once, in its common bucket of the least key. In a
large bucket the elements themselves are compared, too, by 16 bits of each: what they have in common at
most is a bound that no link misses, and only few pairs of a large family whose members are nearly
alike enough are left to be confirmed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 8
SIDE = 128  # members of a bucket that are compared at once, or of one side of a block
KEYS = 1 << 21  # band keys that a task holds before it sends them
PART = 1 << 20  # about the keys of one range
CONFIRM = 1 << 20  # about the bytes of items that are compared at once
#: From a column of items to the values of their sorted sets and the number before each.
Expand = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of packed signatures: p = C + (1 - C) * J with C = 2 ** -BITS."""
    d = a ^ b
    for k in (4, 2, 1):
        d |= d >> np.uint64(k)
    differ = np.bitwise_count(d & np.uint64(0x0101010101010101)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / (a.shape[-1] * 64 / BITS) - chance) / (1 - chance)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` neighbouring minima, distinct between bands, from packed signatures."""
    cells = np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), -1)
    bands = cells.shape[1] // rows
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        acc = (acc << np.uint64(8)) ^ (acc >> np.uint64(56)) ^ cells[:, r : rows * bands : rows]
    return C.mix(acc)


def as_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items that are the sorted sets themselves."""
    return column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach percent / 100."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    values = np.concatenate([a, b])
    values.sort()
    both = np.count_nonzero(values[1:] == values[:-1])
    return 100 * both >= percent * (len(a) + len(b) - both)


def _key_runs(rows: int, parts: int):
    """Map function over (sig): for each range of band keys the sorted keys of this task, each at most twice."""
    starts = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else np.zeros(0, np.uint64)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        use = np.ones(len(keys), dtype=bool)
        use[2:] = keys[2:] != keys[:-2]
        keys = keys[use]
        cut = np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])
        runs = pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(keys)])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), runs], names=["part", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(band_keys(C.matrix(batch.column(0)), rows).reshape(-1))
                n += len(held[-1])
            if n >= KEYS:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return run


def _shared_keys(table: pa.Table) -> pa.Table:
    """The keys of one range that occur twice or more."""
    keys = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]))
    return pa.table({"key": C.as_signed(np.unique(keys[1:][keys[1:] == keys[:-1]]))})


def _members(rows: int, shared: np.ndarray):
    """Map function over (id, sig): one row for each band key that passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(C.matrix(batch.column(1)), rows)
                row, band = np.nonzero(C.passes(shared, keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(C.as_signed(keys[row, band]))], names=["id", "key"])

    return run


def picked(bits: np.ndarray):
    """Map function: the rows whose last column, a hash, passes the filter, without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = C.passes(bits, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
                yield batch.select(batch.schema.names[:-1]).filter(pa.array(hit))

    return run


def _confirm(percent: int, expand: Expand):
    """Map function over (hi, lo, a, b): the pairs whose sets a and b reach percent / 100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * CONFIRM // max(whole.nbytes, 1))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                (a, at_a), (b, at_b) = (expand(batch.column(k)) for k in (2, 3))
                keep = [_similar(a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]], percent) for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["hi", "lo"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _near_hub(least: float):
    """Map function over (hi, lo, a, b): the pairs whose signatures a and b pass the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = estimates(C.matrix(batch.column(2)), C.matrix(batch.column(3))) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["hi", "lo"]).filter(pa.array(near))

    return run


def _prints(expand: Expand):
    """Map function over (id, items): 16 bits of each element of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * CONFIRM // max(whole.nbytes, 1))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                values, bounds = expand(batch.column(1))
                short = (C.mix(values.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
                found = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * np.asarray(bounds)).astype(np.int32)), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["id", "prints"])

    return run


def _within_reach(prints: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets may reach percent / 100: elements of one whose 16 bits occur in the other are at least what both have.

    prints holds the bits of set k from at[k] to at[k + 1]; of a set without bits nothing is known.
    """
    keep = np.ones(len(i), dtype=bool)
    mark = np.zeros(1 << 16, dtype=bool)
    order = np.argsort(i, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else ():
        own = prints[at[i[some[0]]] : at[i[some[0]] + 1]]
        some = some[at[j[some] + 1] > at[j[some]]]
        if not len(own) or not len(some):
            continue
        first, size = at[j[some]], at[j[some] + 1] - at[j[some]]
        starts = np.cumsum(size) - size
        mark[own] = True
        both = np.add.reduceat(mark[prints[np.repeat(first - starts, size) + np.arange(size.sum())]], starts, dtype=np.int64)
        mark[own] = False
        keep[some] = 100 * both >= percent * (len(own) + size - both)
    return keep


def _compare(rows: int, least: float, percent: int):
    """Map function over (block, key, id, comp, side, sig, prints), sorted by block: candidates across components.

    In a block, members of side 0 meet those of side 1; members of side 2 meet each other. A pair
    comes out where its estimate passes, from the bucket of the least key that has both only, and where its
    prints, if there are any, may reach percent / 100.
    """

    def pairs(n: int, side: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side[0] == 2:
            i, j = np.triu_indices(n, 1)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        use = comp[i] != comp[j]
        return i[use], j[use]

    def test(ids: np.ndarray, sig: np.ndarray, bands: np.ndarray, key: np.ndarray, prints: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        near = estimates(sig[i], sig[j]) >= least
        i, j = i[near], j[near]
        own = bands[i]
        here = np.where(own == bands[j], own, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == key[i]
        i, j = i[here], j[here]
        here = _within_reach(*prints, i, j, percent)
        x, y = ids[i[here]], ids[j[here]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.whole_groups(batches):
            block, key, ids, comp, side = (batch.column(k).to_numpy() for k in range(5))
            sig = C.matrix(batch.column(5))
            raw, ends = C.string_bytes(batch.column(6).fill_null(b""))
            prints = np.frombuffer(raw.tobytes(), dtype=np.uint16), ends // 2
            bands = C.as_signed(band_keys(sig, rows))
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            some, held = [], 0
            for a, b in zip(first, np.append(first[1:], len(block)), strict=True):
                i, j = pairs(b - a, side[a:b], comp[a:b])
                some.append((i + a, j + a))
                held += len(i)
                if held > 1 << 13 or b == len(block):
                    yield test(ids, sig, bands, key, prints, np.concatenate([x for x, _ in some]), np.concatenate([y for _, y in some]))
                    some, held = [], 0

    return run


def meeting(reps: DataFrame, rows: int, s: C.Scratch) -> tuple[DataFrame, DataFrame]:
    """The sets that share a bucket, and (id, key, n, weight) of their buckets of n members.

    reps is a saved table with one row a set, its columns id bigint, sig binary and others; `rows` minima are a
    band. Most sets share no bucket, so theirs are the only rows of reps that later joins need to move. Near copies share
    many buckets; of those with the same members (by their number and 128 bits over their ids) the one of the least key
    stands for all, as it has the same pairs. weight: how many others the member meets in these buckets, repeats counted.
    """
    signature = reps.select("id", "sig")
    one = reps.select(F.count(F.lit(1)), F.first(F.length("sig"))).first()
    keys = one[0] * ((one[1] or 0) * 8 // BITS // rows)
    parts = 1 << max(3, int(keys // PART).bit_length())
    runs = signature.select("sig").mapInArrow(_key_runs(rows, parts), "part int, keys binary")
    shared = s.save(runs.groupBy("part").applyInArrow(_shared_keys, "key bigint"))
    # what else passes the filter is alone with its key
    members = s.save(signature.mapInArrow(_members(rows, C.bit_filter(shared, "key")), "id bigint, key bigint"))
    print_of = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *print_of).where("n > 1")
    alike = buckets.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("same"))
    sizes = s.save(alike.select("key", "n", (F.col("same") * (F.col("n") - 1)).alias("weight")))
    counted = s.save(C.salted_join(members, sizes, ["key"], "n", F.xxhash64("id")))
    ids = s.save(counted.select("id").distinct().withColumn("hash", F.xxhash64("id")))
    maybe = reps.withColumn("hash", F.xxhash64("id")).mapInArrow(picked(C.bit_filter(ids, "hash")), reps.schema)
    met = s.save(maybe.join(ids.select("id"), "id", "left_semi"))
    s.drop(shared, members, sizes, ids)  # nothing reads them any more
    return met, counted


def link(met: DataFrame, counted: DataFrame, sets: DataFrame, percent: int, rows: int, least: float, s: C.Scratch, known: DataFrame | None = None, expand: Expand = as_sets) -> DataFrame:
    """Components (node, component) of sets that reach a similarity of percent / 100.

    met and counted are the results of `meeting`; sets is a saved table with (id, items) of each set in met, and
    expand turns a column of items into sorted sets. `rows` minima are a band and `least` is the estimated similarity
    under which a candidate is discarded. known holds links (hi, lo) that need no test.
    """
    signature = met.select("id", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = sets.toDF("hi", "a"), sets.toDF("lo", "b")
        return s.save(pairs.join(a, "hi").join(b, "lo").select("hi", "lo", "a", "b").mapInArrow(_confirm(percent, expand), "hi bigint, lo bigint"))

    # first round: each member against the best connected hub of its buckets
    degree = counted.groupBy("id").agg(F.sum("weight").alias("degree"))
    graded = counted.join(degree, "id")
    hubs = s.save(graded.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("hub"), F.first("n").alias("n")))
    best = C.salted_join(counted.select("id", "key"), hubs, ["key"], "n", F.xxhash64("id")).groupBy("id").agg(F.max("hub").alias("hub"))
    pairs = best.select("id", (-F.col("hub.minus")).alias("to")).where("id <> to").select(F.greatest("id", "to").alias("hi"), F.least("id", "to").alias("lo")).distinct()
    a, b = signature.toDF("hi", "a"), signature.toDF("lo", "b")
    first = verified(s.save(pairs.join(a, "hi").join(b, "lo").select("hi", "lo", "a", "b").mapInArrow(_near_hub(least), "hi bigint, lo bigint")))
    first = s.save(first.union(known)) if known is not None else first
    comp = s.save(C.connected_components(first, s))

    # second round: what shares a bucket across components; a large bucket in blocks of its main component against all others
    now = s.save(counted.join(comp, counted["id"] == comp["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    per = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("c")).where("c < m")
    cut = lambda n: F.when(F.col("m") <= SIDE, F.lit(1)).otherwise(F.ceil(n / SIDE)).cast("int")
    mixed = s.save(mixed.select("key", "main", "m", cut(F.col("m") - F.col("c")).alias("lefts"), cut(F.col("m")).alias("rights")))
    dealt = s.save(C.salted_join(now, mixed, ["key"], "m", F.xxhash64("id")))  # saved, as small and large buckets read it several times
    s.drop(counted, hubs, now, mixed)
    small = dealt.where(F.col("m") <= SIDE).select(F.col("key").alias("block"), "key", "id", "comp", F.lit(2).alias("side"))
    large = dealt.where(F.col("m") > SIDE)
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = large.where("comp <> main").select("key", own("lefts").alias("bi"), others("rights").alias("bj"), "id", "comp", F.lit(0).alias("side"))
    right = large.select("key", others("lefts").alias("bi"), own("rights").alias("bj"), "id", "comp", F.lit(1).alias("side"))
    blocks = left.union(right).select(F.xxhash64("key", "bi", "bj").alias("block"), "key", "id", "comp", "side")
    crowded = s.save(large.select("id").distinct())
    prints = s.save(sets.join(crowded, "id", "left_semi").mapInArrow(_prints(expand), "id bigint, prints binary"))
    signed = signature.join(prints, "id", "left").select("id", "sig", "prints")
    full = small.join(signature, "id").select("block", "key", "id", "comp", "side", "sig", F.lit(None).cast("binary").alias("prints"))
    full = full.unionByName(blocks.join(signed, "id").select("block", "key", "id", "comp", "side", "sig", "prints"))
    again = full.repartition("block").sortWithinPartitions("block", "side").mapInArrow(_compare(rows, least, percent), "hi bigint, lo bigint")
    stars = comp.select(F.col("node").alias("hi"), F.col("component").alias("lo"))
    edges = s.save(stars.union(verified(s.save(again.distinct()))))
    return s.save(C.connected_components(edges, s))
