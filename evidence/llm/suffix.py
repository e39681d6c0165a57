"""Exact removal of repeated 100-byte strings by blockwise suffix sorting over a cover sample.

Cover sample. A position is sampled where its 24-byte hash is the least of some 77 in a row,
that is of all 24-byte strings inside one 100-byte string. So any two equal 100-byte strings
have a sampled position at the same distance from their starts, which is what a difference
cover gives for residues of one long text; here it holds across texts that are never joined
into one. A sampled position owns the 100-byte strings for which it is the least: a run of
up to 77 consecutive starts. About one position in 39 is sampled.

Ranks. A run's rank is the first place (doc_id, start) where its whole content occurs with
its sample. They are computed before any sorting, by aggregation.

Blocks. The suffixes to sort are those of runs whose sample occurs with more than one content;
all other ties are long and are settled by rank alone. They are dealt into buckets by sample,
and one block of whole buckets at a time is sorted by its bytes to a depth of 100, on contexts
of at most 175 bytes a run; neighbours in that order are compared byte by byte. Suffixes of a
bucket too large for one task are dealt on by two hashes of their 100 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1
#: Buckets with more runs than this are spread over tasks by content.
BUCKET = 2048
#: Runs that are sorted at once, unless one bucket has more.
BLOCK = 1024


def sampled_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all runs of the texts: text number, sample hash, content hash, first start in the text, number of starts, whether it may repeat itself."""
    size = np.diff(offsets)
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
    up, down = C.POWERS.to(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(C.BYTE_KEYS[raw] * up[:n], out=sums[1:])
    grams = C.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # least of each REACH grams in a row, from prefix and suffix minima of blocks
    whole = -(-len(grams) // REACH) * REACH
    blocks = np.full(whole, ~np.uint64(0))
    blocks[: len(grams)] = grams
    blocks = blocks.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    least = np.minimum(behind[:starts], ahead[REACH - 1 : REACH - 1 + starts])
    # a string must not cross texts, and a run neither
    valid = np.repeat(np.arange(len(size)), np.maximum(size, 0))[:starts]
    inside = np.arange(starts) + LENGTH <= offsets[1:][valid]
    new = np.ones(starts, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    new &= inside
    stop = np.ones(starts, dtype=bool)
    stop[:-1] = new[1:] | ~inside[1:]
    stop &= inside
    at, to = np.flatnonzero(new), np.flatnonzero(stop) + 1
    content = C.mix((sums[to + LENGTH - 1] - sums[at]) * down[at] + (to - at).astype(np.uint64))
    # a run that holds its sample twice (periodic text) may repeat itself
    same = grams[np.minimum(at[:, None] + np.arange(REACH), len(grams) - 1)] == least[at][:, None]
    inner = (same.sum(axis=1) > 1) | (to - at > same.argmax(axis=1) + 1)
    text = valid[at]
    return text, C.mix(least[at]), content, at - offsets[:-1][text], to - at, inner  # minima are small numbers: spread them


def _scan(filter_bits: np.ndarray | None):
    """Map function: the runs of all texts; with a filter those whose sample may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            raw, offsets = C.string_bytes(batch.column(2))
            text, sample, content, at, n, inner = sampled_runs(raw, offsets)
            if filter_bits is None:
                yield pa.RecordBatch.from_arrays([pa.array(C.as_signed(sample))], names=["sample"])
                continue
            hit = np.flatnonzero(inner | C.passes(filter_bits, sample))
            doc, key = (batch.column(i).take(pa.array(text[hit])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(C.as_signed(sample[hit])), pa.array(C.as_signed(content[hit])), doc, key, pa.array(at[hit].astype(np.int32)), pa.array(n[hit].astype(np.int32)), pa.array(inner[hit])],
                names=["sample", "content", "doc_id", "text_key", "at", "n", "inner"],
            )

    return run


def _repeated_filter(docs: DataFrame, s: C.Scratch) -> np.ndarray:
    """Bit filter over the samples that occur twice or more."""
    seen = s.save(docs.mapInArrow(_scan(None), "sample bigint").groupBy("sample").count().where("count > 1").select("sample"))
    out = C.bit_filter(seen, "sample")
    s.drop(seen)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: the bytes under each run to sort."""
    for batch in C.slices(batches):
        raw, offsets = C.string_bytes(batch.column(batch.schema.get_field_index("text")))
        runs = batch.column(batch.schema.get_field_index("runs"))
        lists, flat = np.diff(runs.offsets.to_numpy()), runs.flatten()
        if not len(flat):
            continue
        sample, at, n = (flat.field(i) for i in range(3))
        row = np.repeat(np.arange(len(lists)), lists)
        begin = offsets[:-1][row] + at.to_numpy()
        end = begin + n.to_numpy() + LENGTH - 1
        bound = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(end - begin, out=bound[1:])
        pick = np.repeat(begin - bound[:-1], end - begin) + np.arange(bound[-1])
        context = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(raw[pick])])
        doc, key = (batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in ("doc_id", "text_key"))
        yield pa.RecordBatch.from_arrays([sample, doc, key, at, n, context], names=["sample", "doc_id", "text_key", "at", "n", "context"])


def _bytes_of(context: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bound = np.frombuffer(context.buffers()[1], dtype=np.int32, count=len(context) + 1 + context.offset)[context.offset :].astype(np.int64)
    return np.frombuffer(context.buffers()[2], dtype=np.uint8)[bound[0] : bound[-1]], bound - bound[0]


def _suffixes(n: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix (start) of each run: run number, distance in the run, place in the bytes."""
    run = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return run, k, bound[:-1][run] + k


def sorted_suffixes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at these places by their first 100 bytes, ties as given, and whether each equals the one before it."""
    text = raw[at[:, None] + np.arange(LENGTH)]
    order = np.argsort(text.view(f"S{LENGTH}").ravel(), kind="stable")
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (text[order[1:]] == text[order[:-1]]).all(axis=1)
    return order, again


def _suffix_hashes(n: np.ndarray, context: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of each run: run number, distance in the run, two hashes of its 100 bytes."""
    raw, bound = _bytes_of(context)
    run, k, p = _suffixes(n, bound)
    up, down = C.POWERS.to(len(raw) + 1)
    hashes = []
    for keys in (C.BYTE_KEYS, C.mix(C.BYTE_KEYS) | np.uint64(1)):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(keys[raw] * up[: len(raw)], out=sums[1:])
        hashes.append(C.mix((sums[p + LENGTH] - sums[p]) * down[p]))
    return run, k, *hashes


def _ranges(run: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive distances of a run as (run, first, number)."""
    order = np.lexsort((k, run))
    run, k = run[order], k[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (k[1:] != k[:-1] + 1)
    at = np.flatnonzero(new)
    return run[at], k[at], np.diff(np.append(at, len(run)))


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function over rows sorted by sample: repeated starts, found one block of whole buckets at a time."""

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        doc, key, at = (rows.column(i).to_numpy() for i in (1, 2, 3))
        order = np.lexsort((at, key, doc))  # rows of docs that are equal count as one
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(doc[order]) != 0) | (np.diff(key[order]) != 0) | (np.diff(at[order]) != 0)
        rows = rows.take(pa.array(order[fresh]))
        doc, key, at = (rows.column(i).to_numpy() for i in (1, 2, 3))
        raw, bound = _bytes_of(rows.column(5))
        run, k, p = _suffixes(rows.column(4).to_numpy().astype(np.int64), bound)  # in the order of their places
        order, again = sorted_suffixes(raw, p)
        r, first, number = _ranges(run[order][again], k[order][again])
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(key[r]), pa.array((at[r] + first).astype(np.int32)), pa.array((at[r] + first + number + LENGTH - 1).astype(np.int32))], names=["doc_id", "text_key", "begin", "end"])

    for batch in C.whole_groups(batches):
        sample = batch.column(0).to_numpy()
        first = np.append(np.flatnonzero(np.append(True, sample[1:] != sample[:-1])), len(sample))
        at = 0
        while at < len(first) - 1:
            end = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, side="right")) - 1)
            yield block(batch.slice(first[at], first[end] - first[at]))
            at = end


def _explode_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: one row for each suffix of large buckets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run, k, one, two = _suffix_hashes(batch.column(4).to_numpy().astype(np.int64), batch.column(5))
        take = pa.array(run)
        yield pa.RecordBatch.from_arrays([pa.array(C.as_signed(one)), pa.array(C.as_signed(two)), batch.column(1).take(take), batch.column(2).take(take), pa.array((batch.column(3).to_numpy()[run] + k).astype(np.int32))], names=["one", "two", "doc_id", "text_key", "at"])


def _cut(as_text: bool):
    """Map function: what stays of each text when its ranges go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            raw, offsets = C.string_bytes(col["text"])
            out = []
            for i, ranges in enumerate(col["ranges"].to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                spans: list[list[int]] = []
                for x in sorted((r["begin"], r["end"]) for r in ranges or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                keep = np.ones(len(text), dtype=bool)
                for a, b in spans:
                    keep[a:b] = False
                rest = text[keep].tobytes()
                out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            n, gone, spans, sha, rest = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array([x.decode(errors="ignore") for x in rest], pa.string()) if as_text else pa.array(rest, pa.binary()), col["extra"]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "extra"],
            )

    return run


def repeated_ranges(docs: DataFrame, s: C.Scratch) -> DataFrame:
    """Byte ranges (doc_id, text_key, begin, end) covered by a 100-byte string that also starts earlier.

    docs has doc_id, text_key and text. Ranges of one text may overlap. Texts are ordered by
    (doc_id, text_key); rows that agree in both count as one.
    """
    maybe = s.save(docs.mapInArrow(_scan(_repeated_filter(docs, s)), "sample bigint, content bigint, doc_id bigint, text_key bigint, at int, n int, inner boolean"))
    ranks = s.save(maybe.groupBy("sample", "content").agg(F.min(F.struct("doc_id", "text_key", "at")).alias("first"), F.min("n").alias("n"), F.max("inner").alias("inner"), F.count(F.lit(1)).alias("times")))
    tied = ranks.where("times > 1").select("sample", "content", "first")
    later = F.struct("doc_id", "text_key", "at") > F.col("first")
    by_rank = maybe.join(tied, ["sample", "content"]).where(later).select("doc_id", "text_key", F.col("at").alias("begin"), (F.col("at") + F.col("n") + (LENGTH - 1)).alias("end"))

    buckets = ranks.groupBy("sample").agg(F.count(F.lit(1)).alias("runs"), F.max("inner").alias("inner")).where("runs > 1 or inner").select("sample", "runs")
    sort = ranks.join(buckets, "sample").select("first.*", F.struct("sample", F.col("first.at").alias("at"), "n").alias("run"), "runs")
    by_text = sort.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("run.*")).alias("runs"))
    contexts = s.save(docs.join(by_text.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs").mapInArrow(_contexts, "sample bigint, doc_id bigint, text_key bigint, at int, n int, context binary"))
    hot = buckets.where(F.col("runs") > BUCKET).select("sample")
    cold = contexts.join(hot, "sample", "left_anti").repartition("sample").sortWithinPartitions("sample")
    by_bucket = cold.mapInArrow(_sort_buckets, "doc_id bigint, text_key bigint, begin int, end int")

    suffixes = contexts.join(hot, "sample", "left_semi").mapInArrow(_explode_suffixes, "one bigint, two bigint, doc_id bigint, text_key bigint, at int")
    least = suffixes.groupBy("one", "two").agg(F.min(F.struct("doc_id", "text_key", "at")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    by_suffix = suffixes.join(least, ["one", "two"]).where(later).select("doc_id", "text_key", F.col("at").alias("begin"), (F.col("at") + LENGTH).alias("end"))
    return by_rank.union(by_bucket).union(by_suffix)


def suffix_dedup(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False, scratch: C.Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    docs needs doc_id and text; a text is its UTF-8 bytes. Every byte goes that a 100-byte
    string covers which also starts earlier: in a smaller doc_id, or in the same document at
    a smaller start. kept holds the remaining bytes (a cut may split a character); with as_text
    it is a string without what is left of split characters. Columns named in carry are
    passed on; others are not read.

    Texts of one doc_id are ordered by their hash; rows that agree in doc_id and text are one
    document, and each gets its result. Null or empty text: no bytes, nothing removed. A null
    doc_id comes before all others. Empty table: no rows.
    """
    s = scratch or C.Scratch(docs.sparkSession, "suffix")
    first = -(2**63)
    extra = F.struct(F.lit(0).alias("none"), *carry).alias("extra")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(first)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), extra).withColumn("text_key", F.xxhash64("text"))
    ranges = s.save(repeated_ranges(keyed.select("doc_id", "text_key", "text"), s)).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = keyed.join(ranges.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges", "extra")
    cut = joined.mapInArrow(_cut(as_text), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept {'string' if as_text else 'binary'}, extra {joined.schema['extra'].dataType.simpleString()}")
    return cut.select(F.when(F.col("doc_id") > first, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(F.col(f"extra.`{c}`") for c in carry))
