"""Helpers that the operators of this subpackage share.

`Scratch` writes intermediate tables into the shared checkpoint folder, so that a
lost executor costs a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (a test) gets an own folder; a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call.

    What the returned table still reads stays in the shared folder; the caller may delete `root`
    when it has used the result, as the pipeline does between its stages.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and return the table that reads it."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside the lambdas of body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has an edge.

    `edges` has two bigint columns, hi and lo, with hi > lo; repeated edges are allowed.
    Returns (node, component) for each node that is not itself the smallest of its
    component. Alternating large-star and small-star rounds; each round moves every
    node nearer to its minimum, so a path of n nodes takes O(log(n)^2) rounds. Nothing
    but a row count and a digest comes to the driver.
    """
    cur = scratch.save(edges.select("hi", "lo").distinct())

    def digest(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    before = digest(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.select(F.col("lo").alias("n"), F.col("hi").alias("x")).union(cur.select(F.col("hi").alias("n"), F.col("lo").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = cur.join(least, cur["lo"] == least["n"]).select("hi", F.col("m").alias("lo")).distinct()
        least2 = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        small = large.join(least2, large["hi"] == least2["n"]).where(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = scratch.save(small.union(least2.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct())
        scratch.drop(cur)
        cur, after = new, digest(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def placed(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """Rows with their place in an order, from 1.

    Rows are sorted in range partitions and written with their partition and their number in it, so the places do not
    depend on a second evaluation; of the counts of partitions, one row a task, a running sum is taken.
    """
    part = F.spark_partition_id()
    mine = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).withColumn("_mine", mine))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_mine") + 1).drop("_part", "_mine", "_before")


#: A key that has more than this share of all rows is hot; so at most its inverse of keys are.
HOT_SHARE, SALTS = 1000, 64


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], times: str, by: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join of left with right, which has one row a key and in `times` the rows of left with that key.

    The rows of hot keys are dealt by `by`, an integer column of left, over SALTS tasks. Fewer than
    HOT_SHARE keys can be hot, so their list may be broadcast. total: the sum of times, if known.
    """
    total = total if total is not None else right.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * HOT_SHARE > F.lit(total)
    named = F.broadcast(right.where(hot).select(*keys, F.lit(True).alias("_hot")))
    left = left.join(named, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0))
    right = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt", "_hot")


def whole_groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by a column of longs, cut again so that no group of equal values is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy()
        last = int(np.searchsorted(value, value[-1]))  # the group that may go on
        if held and (last or held[0].column(column)[0].as_py() != value[0]):
            yield joined([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield batch.slice(0, last)
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


#: Bounds of a bit filter: at least 2**17 bits, at most 2**28 (32 MB); beyond, it only passes more.
FILTER_BITS = (17, 28)


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """Bit set over the distinct 64-bit hashes in a column of a saved table, to be sent to all tasks.

    It passes all of them and one in 64 others; its size follows their number within FILTER_BITS.
    """
    bits = min(max(int(64 * values.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    word = F.shiftrightunsigned(F.col(column), 70 - bits).alias("word")
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))")
    found = values.groupBy(word).agg(F.bit_or(one).alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit value may be in a bit filter."""
    at = values >> np.uint64(65 - (len(bits) * 64).bit_length())
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


# ---------------------------------------------------------------- bytes of Arrow batches

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_B = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random odd 64-bit number for each byte value.
BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finisher of a well-known hash function)."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _B):
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(self.base, -1, 2**64)
            steps = np.full(n, self.base, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = inverse
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about `most` bytes of text (one long text alone may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of each text, and the number of words before each text."""
    if lower:
        raw = _LOWER[raw]
    n = len(raw)
    space = _IS_SPACE[raw]
    first = ~space
    starts_text = np.zeros(n + 1, dtype=bool)
    starts_text[offsets] = True
    begin = first.copy()
    begin[1:] &= space[:-1] | starts_text[1:n]
    end = first.copy()
    if n:
        end[:-1] &= space[1:] | starts_text[1:n]
    at, to = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return string_hashes(raw, at, to), np.searchsorted(at, offsets)


#: Masks of the first k of eight bytes, and a number that keeps equal bytes of different lengths apart.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LENGTH = mix(np.arange(1, 10, dtype=np.uint64) * np.uint64(_B))


def string_hashes(raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings raw[at:to]: up to eight bytes their bytes, mixed one to one; longer ones by BLAKE2b.

    A polynomial over the bytes would do with less work, but whole families of texts are known that have one value of it.
    """
    size = to - at
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    head = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))[at]
    short = np.minimum(size, 8)
    out = mix(mix(head & _FIRST[short]) + _LENGTH[short])
    long = np.flatnonzero(size > 8)
    if len(long):
        data = raw.tobytes()
        words = [data[i:j] for i, j in zip(at[long].tolist(), to[long].tolist(), strict=True)]
        known = {w: blake2b(w, digest_size=8).digest() for w in set(words)}
        out[long] = np.frombuffer(b"".join([known[w] for w in words]), dtype=np.uint64)
    return out


def digests(raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of the strings raw[at:to], as two columns."""
    data = memoryview(raw.tobytes())
    found = b"".join([blake2b(data[i:j], digest_size=16).digest() for i, j in zip(at.tolist(), to.tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.uint64).reshape(-1, 2)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, in order, and the number before each text.

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    n = len(words)
    counts = np.diff(bounds)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(number, out=out_bounds[1:])
    starts = np.repeat(bounds[:-1] - out_bounds[:-1], number) + np.arange(out_bounds[-1])
    left = np.repeat(np.minimum(counts, size), number)
    acc = left.astype(np.uint64)
    for k in range(size):
        has = left > k
        acc = mix(acc * np.uint64(_B) ^ np.where(has, words[np.minimum(starts + k, max(n - 1, 0))] if n else 0, np.uint64(0)).astype(np.uint64))
    return acc, out_bounds


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and the number before each text."""
    values = values[bounds[0] : bounds[-1]].copy()
    bounds = bounds - bounds[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    before = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(new, out=before[1:])
    return values[new], before[bounds]


def minima(values: np.ndarray, bounds: np.ndarray, n: int, seed: int) -> np.ndarray:
    """MinHash minima, one row a text and one column a hash function; texts must not be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, size=n, dtype=np.uint64)
    out = np.empty((len(bounds) - 1, n), dtype=np.uint64)
    at = 0
    while at < len(bounds) - 1:  # blocks that stay in the processor's cache
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 16384, side="right")) - 1)
        part, starts = values[bounds[at] : bounds[end]], bounds[at:end] - bounds[at]
        buffer = np.empty_like(part)
        for k in range(n):
            np.multiply(part, a[k], out=buffer)
            np.add(buffer, b[k], out=buffer)
            out[at:end, k] = np.minimum.reduceat(buffer, starts)
        at = end
    return out


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of minima, side by side in 64-bit words."""
    cells = 64 // bits
    part = (low & np.uint64((1 << bits) - 1)).reshape(low.shape[0], -1, cells)
    return np.bitwise_or.reduce(part << (np.arange(cells, dtype=np.uint64) * np.uint64(bits)), axis=2)


def as_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def binary_rows(values: np.ndarray) -> pa.Array:
    """An Arrow binary column: the bytes of each row."""
    width = values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, (len(values) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def matrix(column: pa.Array) -> np.ndarray:
    """The unsigned longs of a binary column whose rows have one length."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=np.uint64).reshape(len(column), -1)
