"""Ordered scans whose state depends on all rows before: one group is one sitting day or one recording.

The groups are bounded by what they describe (a day's speeches, a quotation's words), so each
runs in one task as an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches, sorted by their first `keys` columns, cut again so that no group is divided, each with the ends of its groups.

    Many small groups share a batch; Spark's own call for each group costs more than a millisecond.
    """

    def told(batch: pa.RecordBatch, at: int) -> str:
        return repr([batch.column(k)[at].as_py() for k in range(keys)])

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ends = [0, *_starts(whole, keys).tolist(), whole.num_rows]
        return whole, list(zip(ends[:-1], ends[1:], strict=True))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and told(held[0], 0) != told(batch, 0):
            yield cut(held)
            held = []
        if len(starts):  # the last group may go on
            last = int(starts[-1])
            yield cut([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield cut(held)


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Places, from 1 on, at which the key is another than that of the row before."""
    new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in range(keys):
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= code[1:] != code[:-1]
    return np.flatnonzero(new) + 1


@lru_cache(1 << 16)
def _readings(digits: str) -> list[int]:
    """Seconds of the day that up to six digits may mean: HHMMSS, and HHMM for four at most."""
    out = []
    if digits and digits.isdigit() and len(digits) <= 6:
        six = digits.zfill(6)
        h, m, s = int(six[:2]), int(six[2:4]), int(six[4:])
        if h < 24 and m < 60 and s < 60:
            out.append(h * 3600 + m * 60 + s)
        if len(digits) <= 4:
            four = digits.zfill(4)
            h, m = int(four[:2]), int(four[2:])
            if h < 24 and m < 60:
                out.append(h * 3600 + m * 60)
    return list(dict.fromkeys(out))


def resolve_clock(values: list[str | None], morning: int = 7 * 3600, gap: int = 6 * 3600, last: int | None = None, day: int = 0) -> tuple[list[int | None], int | None, int]:
    """Seconds since the first day's midnight for ambiguous clock digits in order, and the last time and its day to go on from.

    The first row prefers a reading from the morning on; then the reading and day (this one or the
    next) with the smallest step forward wins. No step within the gap: the reading nearest to the
    last time, on the current day, while the last time itself never moves back. No reading: null,
    and nothing moves.
    """
    out: list[int | None] = []
    for v in values:
        options = _readings(v or "")
        if not options:
            out.append(None)
            continue
        if last is None:
            late = [x for x in options if x >= morning]
            at = last = (late or options)[0]
        else:
            steps = [(x + d * DAY - last, x, d) for d in (day, day + 1) for x in options if 0 <= x + d * DAY - last <= gap]
            if steps:
                _, x, day = min(steps)
                at = last = x + day * DAY
            else:
                at = min((x + day * DAY for x in options), key=lambda t: abs(t - last))
                last = max(last, at)
        out.append(at)
    return out, last, day


def ambiguous_clocks(rows: DataFrame, key: list[str], pos: str, digits: str) -> DataFrame:
    """Rows with `at`, the resolved second of their group's first day."""

    at = rows.columns.index(digits)
    # as mapInArrow sees them: the keys first, which are columns of the rows, too
    tagged = rows.select(*[F.col(k).alias(f"_{k}") for k in key], *rows.columns)
    dealt = tagged.repartition(*[f"_{k}" for k in key]).sortWithinPartitions(*[f"_{k}" for k in key], F.col(pos).asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in whole_groups(batches, len(key)):
            values = [x if isinstance(x, str) else None for x in batch.column(len(key) + at).to_pylist()]
            found = [t for a, b in groups for t in resolve_clock(values[a:b])[0]]
            own = range(len(key), batch.num_columns)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in own], pa.array(found, pa.int64())], names=[*[batch.schema.names[i] for i in own], "at"])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return dealt.mapInArrow(run, f"{schema}, at bigint")


def match_in_order(left: list[str], right: list[str], ahead: int = 6) -> list[int | None]:
    """For each left label the place of the equal right label among the next `ahead`; a match moves the cursor past it."""
    out: list[int | None] = []
    at = 0
    for x in left:
        hit = next((i for i in range(at, min(at + ahead, len(right))) if right[i] == x), None)
        out.append(hit)
        if hit is not None:
            at = hit + 1
    return out


def greedy_anchor_match(left: DataFrame, right: DataFrame, key: list[str], pos: str, label: str, anchor: str, ahead: int = 6) -> DataFrame:
    """Left rows with the anchor of their match in the right list of the group, in order; null without one.

    Both lists go through one group as a tagged union, so that they may come from one table.
    """
    kind = right.schema[anchor].dataType.simpleString()
    row = F.struct(*left.columns)
    every = left.select(*key, F.col(pos).alias("_pos"), F.col(label).alias("_label"), row.alias("_row"), F.lit(None).cast(kind).alias("_anchor"), F.lit(True).alias("_left"))
    every = every.unionByName(right.select(*key, F.col(pos).alias("_pos"), F.col(label).alias("_label"), F.lit(None).cast(every.schema["_row"].dataType).alias("_row"), F.col(anchor).alias("_anchor"), F.lit(False).alias("_left")))
    dealt = every.repartition(*key).sortWithinPartitions(*key, F.desc("_left"), F.col("_pos").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in whole_groups(batches, len(key)):
            labels, rows, anchors, is_left = (batch.column(len(key) + i) for i in (1, 2, 3, 4))
            labels, is_left = labels.to_pylist(), is_left.to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(is_left)]).tolist()
            hits: list[int | None] = []
            for a, b in groups:  # the left rows come first
                middle = a + before[b] - before[a]
                hits += [None if h is None else middle + h for h in match_in_order(labels[a:middle], labels[middle:b], ahead)]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(np.flatnonzero(is_left))), anchors.take(pa.array(hits, pa.int64()))], names=["_row", "_anchor"])

    found = dealt.mapInArrow(run, f"_row {every.schema['_row'].dataType.simpleString()}, _anchor {kind}")
    return found.select("_row.*", F.col("_anchor").alias(anchor))


class Automaton:
    """The runs of a list of words: a suffix automaton, built and searched in linear time."""

    def __init__(self, words: list[str]):
        self.size, self.link, self.next = [0], [-1], [{}]
        last = 0
        for w in words:
            new = self._state(self.size[last] + 1, {})
            at = last
            while at >= 0 and w not in self.next[at]:
                self.next[at][w] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._ending(at, w)
            last = new

    def _state(self, size: int, following: dict[str, int]) -> int:
        self.size.append(size)
        self.link.append(0)
        self.next.append(following)
        return len(self.size) - 1

    def _ending(self, at: int, w: str) -> int:
        """The state of exactly the runs of state `at` and w; split off where that state holds longer ones, too."""
        then = self.next[at][w]
        if self.size[then] == self.size[at] + 1:
            return then
        own = self._state(self.size[at] + 1, dict(self.next[then]))
        self.link[own] = self.link[then]
        self.link[then] = own
        while at >= 0 and self.next[at].get(w) == then:
            self.next[at][w] = own
            at = self.link[at]
        return own

    def longest(self, words: Iterable[str]) -> tuple[int, int]:
        """Start and length of the longest run of words that the list holds (ties: the earliest)."""
        best, at, n = (0, 0), 0, 0
        for i, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if w in self.next[at]:
                at = self.next[at][w]
                n += 1
            if n > best[1]:
                best = (i - n + 1, n)
        return best


def longest_run(heard: list[str], said: list[str]) -> tuple[int, int]:
    """Start in heard and length of the longest run of words that both hold (ties: the earliest)."""
    return Automaton(said).longest(heard)


def longest_common_block(words: DataFrame, quotes: DataFrame, key: str, pos: str, word: str, start: str, end: str, quote: str) -> DataFrame:
    """By group with a quote: first and last second and the number of words of the longest run that the quote shares.

    words has a row for each heard word, quotes one for each group (of several the least); a group without heard words has
    no row. Letters in lower case and marks at the ends of words do not count.
    """
    one = quotes.groupBy(key).agg(F.min(quote).alias("_quote"))

    def plain(x: str) -> str:
        return x.lower().strip(".,!?;:\"'")

    def run(group: tuple, heard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if heard.empty or asked.empty:
            return pd.DataFrame({key: [], "begin": [], "finish": [], "n_words": []})
        heard = heard.sort_values(pos)
        at, n = longest_run([plain(str(x)) for x in heard[word]], [plain(x) for x in (asked["_quote"].iloc[0] or "").split()])
        span = heard.iloc[at : at + n]
        return pd.DataFrame({key: [group[0]], "begin": [span[start].iloc[0] if n else None], "finish": [span[end].iloc[-1] if n else None], "n_words": [n]})

    kind = words.schema[key].dataType.simpleString()
    return words.select(key, pos, word, start, end).groupBy(key).cogroup(one.groupBy(key)).applyInPandas(run, f"{key} {kind}, begin double, finish double, n_words int")
