"""Near-duplicate lines: one line of each component stays.

A line is compared by its runs of five characters, after A-Z are lower-cased and white space
at its ends is cut. One hash of each run gives 168 minima by one permutation: the hash picks
the bin, the least hash in a bin is its minimum, and an empty bin borrows from bins that
other hash functions pick. 24 bands of 7 minima find the candidates (a pair at a similarity
of 0.8 misses all of them with a probability of 0.004; unlike lines hardly ever share a
band, so that candidates do not grow with the square of the corpus), exact comparison
confirms them, and distributed union-find joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .linking import BITS, link, meeting, picked

BINS, ROWS = 168, 7
#: Estimated similarity under which a candidate is discarded: at a similarity of 0.8 with a probability of 0.00003, far less than the bands lose.
LEAST = 0.67
CHARS = 5
_EMPTY = ~np.uint64(0)
#: Bins that an empty bin asks one after the other.
_ASK = np.random.default_rng(11).integers(0, BINS, size=(16, BINS, 4))
_BIN = np.arange(BINS)
#: How many fours of them are asked one by one.
ALONE = 2
#: Random odd factors: of the characters of a run, and of the minimum of each bin.
_KEYS, _SPREAD = (np.random.default_rng(seed).integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, n in ((20240229, 3 + CHARS), (31, BINS)))


class Lines:
    """The lines of a slice of texts: where they begin and end, without white space at the ends."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        self.raw = raw = raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))  # A-Z lower-cased
        breaks = np.flatnonzero(raw == 10)
        text_of = np.searchsorted(offsets, breaks, side="right") - 1
        whole = len(offsets) - 1
        first = np.concatenate([offsets[:-1], breaks + 1])
        last = np.concatenate([breaks, offsets[1:]])
        text = np.concatenate([np.arange(whole), text_of])
        order = np.lexsort((first, text))
        self.begin, self.text = first[order], text[order]
        # ends in the same order: the breaks of a text, then its end
        end_text = np.concatenate([text_of, np.arange(whole)])
        self.end = last[np.lexsort((last, end_text))]
        starts = np.searchsorted(self.text, np.arange(whole))
        self.pos = np.arange(len(self.text)) - starts[self.text]
        solid = np.append((raw != 32) & (raw - np.uint8(9) >= 5), False)  # no white space
        self.a, self.b = self.begin.copy(), self.end.copy()
        full = self.begin < self.end
        late = np.flatnonzero(full & ~solid[self.begin])
        if len(late):
            opens = np.append(np.flatnonzero(solid[1:-1] & ~solid[:-2]) + 1, n)  # where words begin after white space
            self.a[late] = opens[np.searchsorted(opens, self.begin[late])]
            full[late] = self.a[late] < self.end[late]
        early = np.flatnonzero(full)
        early = early[~solid[self.end[early] - 1]]
        if len(early):
            ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
            self.b[early] = ends[np.searchsorted(ends, self.end[early], side="right") - 1]
        self.a[~full] = self.b[~full] = self.begin[~full]
        self.full = full

    def digests(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of a 128-bit digest of each picked line."""
        found = C.digests(self.raw, self.a[pick], self.b[pick])
        return found[:, 0].copy(), found[:, 1].copy()

    def grams(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of five characters of the picked lines, which have a word, and the number before each."""
        before = np.zeros(len(self.raw) + 1, dtype=np.int32)  # characters before each byte
        np.cumsum(self.raw.view(np.int8) > -65, out=before[1:])
        c0, c1 = before[self.a[pick]].astype(np.int64), before[self.b[pick]].astype(np.int64)
        n = int(before[-1])
        code = self.raw if n == len(self.raw) else np.frombuffer(self.raw.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        every = np.zeros(n, dtype=np.uint64)  # of the run that begins at each character
        for at in range(0, n - CHARS + 1, 1 << 13):  # blocks that stay in the processor's cache
            some = code[at : at + (1 << 13) + CHARS - 1].astype(np.uint64)
            pair = some[:-1] | (some[1:] << np.uint64(32))
            run = pair[:-3] * _KEYS[0]
            run += pair[2:-1] * _KEYS[1]
            run += some[4:] * _KEYS[2]
            every[at : at + len(run)] = C.mix(run)
        number = np.maximum(c1 - c0 - CHARS + 1, 1)
        bounds = np.zeros(len(pick) + 1, dtype=np.int64)
        np.cumsum(number, out=bounds[1:])
        short = np.flatnonzero(c1 - c0 < CHARS)  # a shorter line is its own only run
        if len(short):
            at, size = c0[short], (c1 - c0)[short]
            own = size.astype(np.uint64) * _KEYS[3]
            for k in range(CHARS - 1):
                own += np.where(size > k, code[np.minimum(at + k, n - 1)], 0).astype(np.uint64) * _KEYS[4 + k]
            every[at] = C.mix(own)
        step = np.zeros(n + 1, dtype=np.int8)
        step[c0] += 1
        step[c0 + number] -= 1
        return every[np.cumsum(step[:n], dtype=np.int8).view(bool)], bounds


def bin_minima(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """8 bits of the minima of BINS bins for each line, empty bins filled from others; some lines at a time."""
    parts, at = [], 0
    while at < len(bounds) - 1:
        end = min(max(at + 1, int(np.searchsorted(bounds, bounds[at] + 65536, side="right")) - 1), at + 1024)
        parts.append(_bin_minima(grams[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]))
        at = end
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint8)


def _bin_minima(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = len(bounds) - 1
    out = np.full(rows * BINS, _EMPTY)
    # the upper half of a hash picks the bin; those of one bin are in the order of the rest
    bins = grams >> np.uint64(32)
    bins *= np.uint64(BINS)
    bins >>= np.uint64(32)
    bins = bins.view(np.int64)
    bins += np.repeat(np.arange(0, rows * BINS, BINS), np.diff(bounds))
    np.minimum.at(out, bins, grams)
    held = out != _EMPTY
    left = np.flatnonzero(~held)
    column = left % BINS
    for asks in _ASK[:ALONE].transpose(0, 2, 1).reshape(-1, BINS):  # one bin at a time; most empty bins find theirs here
        if not len(left):
            break
        ask = (asks - _BIN).take(column)
        ask += left
        there = held.take(ask)
        hit, miss = np.flatnonzero(there), np.flatnonzero(~there)
        out[left.take(hit)] = out.take(ask.take(hit))
        left, column = left.take(miss), column.take(miss)
    first = left - column
    for asks in _ASK[ALONE:]:  # then four bins at a time
        if not len(left):
            break
        ask = asks.take(column, axis=0)
        ask += first[:, None]
        there = held.take(ask)
        at = np.arange(0, 4 * len(left), 4) + there.argmax(axis=1)
        hit = there.ravel().take(at)
        out[left[hit]] = out.take(ask.ravel().take(at)[hit])
        left, first, column = left[~hit], first[~hit], column[~hit]
    if len(left):  # hardly ever: the first bin of the line that is not empty
        out[left] = out.take(first + held.reshape(rows, BINS).argmax(axis=1)[first // BINS])
    # another product for each bin, so that bins with one source do not agree by one chance
    out = out.reshape(rows, BINS)
    out *= _SPREAD
    out >>= np.uint64(64 - BITS)
    return out.astype(np.uint8)


def _place(doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the place of a line."""
    return C.mix(C.mix(doc.view(np.uint64) * np.uint64(3)) + key.view(np.uint64) + pos.astype(np.uint64) * np.uint64(C._B))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: one row for each line with a word, with its signature."""
    for batch in C.slices(batches, most=1 << 18):
        x = Lines(*C.string_bytes(batch.column(2)))
        pick = np.flatnonzero(x.full)
        if len(pick):
            take = pa.array(x.text[pick])
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(x.pos[pick].astype(np.int32)), *(pa.array(C.as_signed(h)) for h in x.digests(pick))]
            yield pa.RecordBatch.from_arrays([*columns, C.binary_rows(bin_minima(*x.grams(pick)))], names=["doc_id", "text_key", "pos", "h1", "h2", "sig"])


def _texts(bits: np.ndarray):
    """Map function: one row for each line with a word; those whose place passes the filter have their text, lower-cased and cut at the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, most=1 << 18):
            x = Lines(*C.string_bytes(batch.column(2)))
            pick = np.flatnonzero(x.full)
            doc, key = (batch.column(k).to_numpy()[x.text[pick]] for k in (0, 1))
            pos = x.pos[pick]
            place = _place(doc, key, pos)
            texts = [x.raw[a:b].tobytes() if hit else None for a, b, hit in zip(x.a[pick].tolist(), x.b[pick].tolist(), C.passes(bits, place).tolist(), strict=True)]
            columns = [pa.array(v) for v in (doc, key, pos.astype(np.int32), *map(C.as_signed, (*x.digests(pick), place)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, type=pa.binary())], names=["doc_id", "text_key", "pos", "h1", "h2", "place", "items"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function over (id, h1, h2, doc_id, text_key, pos): the hash of the place instead of the place."""
    for batch in batches:
        doc, key, pos = (batch.column(k).to_numpy() for k in (3, 4, 5))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(C.as_signed(_place(doc, key, pos)))], names=["id", "h1", "h2", "place"])


def _gram_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted sets of the five-character runs of lines; those of equal lines, as of a hub, are made once."""
    items = column.dictionary_encode()
    x = Lines(*C.string_bytes(items.dictionary.cast(pa.string())))
    values, bounds = C.distinct_sorted(*x.grams(np.arange(len(items.dictionary))))
    at = items.indices.to_numpy()
    out = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(np.diff(bounds)[at], out=out[1:])
    return np.concatenate([values[bounds[k] : bounds[k + 1]] for k in at.tolist()]), out


def line_components(docs: DataFrame, percent: int, s: C.Scratch) -> DataFrame:
    """All lines with a word but the kept ones: (doc_id, text_key, pos) of each line to drop."""
    schema = "doc_id bigint, text_key bigint, pos int, h1 bigint, h2 bigint"
    place = F.struct("doc_id", "text_key", "pos")
    # one class for each distinct line; its first place goes before the signature in the order
    first = F.min(F.struct("doc_id", "text_key", "pos", "sig")).alias("first")
    classes = docs.mapInArrow(_scan, f"{schema}, sig binary").groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("times"))
    reps = s.save(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "times", *[F.col(f"first.{c}").alias(c) for c in ("doc_id", "text_key", "pos", "sig")]))

    met, counted = meeting(reps, ROWS, s)
    several = s.save(reps.where("times > 1").select("id", "h1", "h2", "times", place.alias("own")))
    s.drop(reps)  # with all signatures, nearly as large as the input
    # the text of one line of each class: that of its first place
    at = s.save(met.select("id", "h1", "h2", "doc_id", "text_key", "pos").mapInArrow(_places, "id bigint, h1 bigint, h2 bigint, place bigint"))
    every = s.save(docs.mapInArrow(_texts(C.bit_filter(at, "place")), f"{schema}, place bigint, items binary"))
    texts = every.where("items is not null").select("place", "h1", "h2", "items").distinct()
    sets = s.save(at.join(texts, ["place", "h1", "h2"]).select("id", "items"))

    comp = link(met, counted, sets, percent, ROWS, LEAST, s, expand=_gram_sets)
    grouped = s.save(comp.select("node", "component").union(comp.select(F.col("component").alias("node"), "component").distinct()))
    near = s.save(grouped.join(met.select("id", "h1", "h2", "times", place.alias("own")), F.col("node") == F.col("id")).select("component", "id", "h1", "h2", "times", "own"))
    stays = near.groupBy("component").agg(F.min("own").alias("keeper"), F.count(F.lit(1)).alias("n"))
    near = s.save(C.salted_join(near, stays, ["component"], "n", F.col("h1")).select("id", "h1", "h2", "times", "keeper"))
    # what a class keeps: the keeper of its component, or of equal lines without one the first
    alone = several.join(near, "id", "left_anti").select("h1", "h2", "times", F.col("own").alias("keeper"))
    some = s.save(near.drop("id").union(alone))
    lines = every.select("doc_id", "text_key", "pos", "h1", "h2", F.col("h1").alias("hash")).mapInArrow(picked(C.bit_filter(some, "h1")), schema)
    return C.salted_join(lines, some, ["h1", "h2"], "times", F.col("doc_id")).where(place != F.col("keeper")).select("doc_id", "text_key", "pos")


def _rest(text: Column, gone: Column) -> Column:
    """A text without the lines at the places in gone."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return C.let(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(kept(lines), lambda k: F.get(lines, k)), "\n"))


def line_dedup(docs: DataFrame, percent: int = 80, carry: tuple[str, ...] = (), scratch: C.Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_kept, clean_text.

    docs needs doc_id and text. Lines are linked when 100 * |intersection| >= percent *
    |union| of their sets of five-character runs (a shorter line is its own only run); of each
    component over all documents the first line by (doc_id, text, place) stays. Lines
    without a word always stay. Columns named in carry are passed on; others are not read.

    Null text: no lines, clean_text null. Empty text: one line, which stays. Rows that agree in
    doc_id and text are one document and each gets its result. A null doc_id comes before all
    others. Empty table: no rows.
    """
    s = scratch or C.Scratch(docs.sparkSession, "lines")
    first = -(2**63)
    extra = F.struct(F.lit(0).alias("none"), *carry).alias("extra")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(first)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", extra)
    gone = line_components(keyed.select("doc_id", "text_key", "text"), percent, s)
    gone = s.save(gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone")))
    joined = keyed.join(gone.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    n_gone = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_rest(F.col("text"), F.col("gone")))
    doc_id = F.when(F.col("doc_id") > first, F.col("doc_id")).alias("doc_id")
    return joined.select(doc_id, n_lines.alias("n_lines"), (n_lines - n_gone).alias("n_kept"), text.alias("clean_text"), *(F.col(f"extra.`{c}`").alias(c) for c in carry))
