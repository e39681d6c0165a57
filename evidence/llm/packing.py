"""Best-fit packing of tokenised documents by linear grouping.

Only the histogram of piece lengths, at most `capacity` numbers, comes to the driver. The
plan made from it says, for each length and each range of ranks among the pieces of that
length, which sequences they go to; its size depends on the capacity and on the number of
groups, not on the documents. Ranks and offsets are computed by Spark. Full pieces are
sequences of their own and need no rank.

1. Pieces longer than capacity / 8 are sorted by length and cut into `groups` groups of equal
   cardinality; each length is rounded up to its group's largest.
2. How often each configuration (a multiset of the few rounded sizes that fits) is used is
   the linear programme of cutting stock, solved by column generation: a knapsack prices new
   configurations. Whole uses are taken; what the fractions leave, at most a bin for each
   size, goes into the fullest bins that hold the largest size left.
3. The actual pieces take the places of the rounded ones.
4. The small pieces go, longest first, where they fit best in what is actually left.

Best-fit decreasing over all lengths is planned too, and the plan of fewer sequences is used.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Pieces of one length that are ranked in one task, about.
RANKED = 100_000
_encoders: dict = {}


def byte_bpe(path: str):
    """An encoder for a byte-level BPE vocabulary file; one for each process.

    Gives the ids of the tokenizers library without added special tokens; the string of a
    special token inside a text is that token, as there.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        of_char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), special
    return _encoders[path]


def _pieces(path: str, capacity: int, end_id: int):
    """Map function: the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, special = byte_bpe(path)
        counter = 0
        for batch in C.slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = encoder.encode(text, allowed_special="all") if any(x in text for x in special) else encoder.encode_ordinary(text)
                ids = np.array([*ids, end_id], dtype="<u4")
                n = len(ids)
                first = n % capacity or capacity
                start = 0
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), counter))
                    start = stop
                    counter += 1
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "counter"])

    return run


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size (descending) to take so that their sum is nearest to room."""
    reach = [1]  # bit s: a sum of s is possible with the sizes so far
    mask = (1 << (room + 1)) - 1
    for size, n in zip(sizes, left, strict=True):
        bits, k, n = reach[-1], 1, min(n, room // size)
        while n > 0:  # n copies as powers of two
            k = min(k, n)
            bits |= (bits << (k * size)) & mask
            n -= k
            k *= 2
        reach.append(bits)
    total = reach[-1].bit_length() - 1
    take = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not (reach[i] >> total) & 1:
            take[i] += 1
            total -= sizes[i]
    return take


class Plan:
    """Ranges of ranks of each length and the sequences they go to.

    `add` says: pieces of `length` with rank lo <= r < hi go to sequence base + (r + shift) // per.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def add(self, length: int, lo: int, hi: int, base: int, shift: int, per: int) -> None:
        self.rows.append((length, lo, hi, base, shift, per))

    def arrays(self) -> dict[str, np.ndarray]:
        table = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 6)
        return {"key": (table[:, 0] << 44) + table[:, 1], "base": table[:, 3], "shift": table[:, 4], "per": table[:, 5]}


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 1500, gap: float = 1e-3) -> list[tuple[list[int], int]]:
    """Configurations and whole numbers of uses that pack most of `counts` pieces of these sizes.

    Column generation: the revised simplex method over the configurations found so far, until
    no configuration costs less than 1 by more than `gap` (the bins are then within `gap` of
    the least fractional number) or `rounds` are over. Uses are rounded down.
    """
    size, n = np.array(sizes), np.array(counts, dtype=float)
    basis = np.diag(capacity // size).astype(float)  # one column a configuration
    inverse = np.diag(1 / (capacity // size))
    for _ in range(rounds):
        worth = inverse.sum(axis=0)  # price of each size
        best = np.full(2 * capacity + 1, -np.inf)  # best[capacity + c]: worth of what fits in c
        best[capacity:] = 0.0
        pick = np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            values = best[capacity + c - size] + worth
            k = int(values.argmax())
            if values[k] > best[capacity + c - 1]:
                best[capacity + c], pick[c] = values[k], k
            else:
                best[capacity + c] = best[capacity + c - 1]
        if best[-1] <= 1 + gap:
            break
        column, c = np.zeros(len(size)), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(size[pick[c]])
        step, uses = inverse @ column, inverse @ n
        ratio = np.divide(uses, step, out=np.full(len(size), np.inf), where=step > 1e-9)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
    uses = np.maximum(np.linalg.solve(basis, n), 0)
    out, left = [], np.array(counts)
    for k in np.argsort(-uses):
        take = basis[:, k].astype(int)
        held = take > 0
        times = int(min(np.floor(uses[k] + 1e-6), (left[held] // take[held]).min()))
        if times > 0:
            out.append((take.tolist(), times))
            left -= take * times
    return out


def make_plan(counts: dict[int, int], capacity: int = 1024, groups: int = 256) -> Plan:
    """The better of linear grouping and best-fit decreasing over the number of pieces of each length."""
    plan, room = _grouped(counts, capacity, groups)
    _best_fit(plan, room, {x: n for x, n in counts.items() if x <= capacity // 8}, capacity)
    plain = Plan()
    _best_fit(plain, {}, counts, capacity)
    return plan if plan.sequences <= plain.sequences else plain


def _grouped(counts: dict[int, int], capacity: int, groups: int) -> tuple[Plan, dict[int, list[tuple[int, int]]]]:
    """The large pieces by linear grouping, and what is left in the bins: space -> runs of bins (first, number)."""
    plan = Plan()
    room: dict[int, list[tuple[int, int]]] = {}
    small = capacity // 8
    if counts.get(capacity):
        plan.add(capacity, 0, counts[capacity], 0, 0, 1)
        plan.sequences = counts[capacity]
    lengths = [x for x in sorted(counts, reverse=True) if small < x < capacity]
    starts = np.cumsum([0, *(counts[x] for x in lengths)]).tolist()  # rank of a length's first piece
    total = starts.pop()
    if not total:
        return plan, room
    length_at = lambda rank: lengths[bisect.bisect_right(starts, rank) - 1]
    q = -(-total // groups)
    firsts, sizes = [], []
    for rank in range(0, total, q):  # groups whose largest lengths are equal are one
        if not sizes or length_at(rank) != sizes[-1]:
            firsts.append(rank)
            sizes.append(length_at(rank))
    left = [b - a for a, b in zip(firsts, [*firsts[1:], total], strict=True)]
    used = [0] * len(sizes)

    def use(take: list[int], times: int) -> None:
        cuts = {0}
        for g, t in enumerate(take):
            if not t:
                continue
            lo = firsts[g] + used[g]
            hi = lo + t * times
            at = bisect.bisect_right(starts, lo) - 1
            while at < len(starts) and starts[at] < hi:
                a, b = max(lo, starts[at]), min(hi, starts[at] + counts[lengths[at]])
                plan.add(lengths[at], a - starts[at], b - starts[at], plan.sequences, starts[at] - lo, t)
                cuts.update({(a - lo) // t, -(-(a - lo) // t)})
                at += 1
        cuts = sorted(c for c in cuts if c < times)
        for c, d in zip(cuts, [*cuts[1:], times], strict=True):
            held = sum(length_at(firsts[g] + used[g] + c * t + k) for g, t in enumerate(take) for k in range(t))
            if held < capacity:
                room.setdefault(capacity - held, []).append((plan.sequences + c, d - c))
        for g, t in enumerate(take):
            used[g] += t * times
            left[g] -= t * times
        plan.sequences += times

    for take, times in configurations(sizes, left, capacity):
        use(take, times)
    while any(left):
        i = next(k for k, n in enumerate(left) if n)
        rest = left.copy()
        rest[i] -= 1
        take = _fullest(sizes, rest, capacity - sizes[i])
        take[i] += 1
        use(take, min(n // t for n, t in zip(left, take, strict=True) if t))
    return plan, room


def _best_fit(plan: Plan, room: dict[int, list[tuple[int, int]]], counts: dict[int, int], capacity: int) -> None:
    """Pieces, longest first, where they fit best."""
    spaces = sorted(room)
    for x in sorted(counts, reverse=True):
        rank, n = 0, counts[x]
        while rank < n:
            at = bisect.bisect_left(spaces, x)
            if at == len(spaces):  # new bins, each filled with this length
                per = min(capacity // x, n - rank)
                bins = (n - rank) // per
                plan.add(x, rank, rank + bins * per, plan.sequences, -rank, per)
                space, first, rank = capacity - per * x, plan.sequences, rank + bins * per
                plan.sequences += bins
            else:
                space = spaces[at]
                first, bins = room[space].pop()
                if bins > n - rank:
                    room[space].append((first + n - rank, bins - (n - rank)))
                    bins = n - rank
                if not room[space]:
                    del room[space], spaces[at]
                plan.add(x, rank, rank + bins, first, -rank, 1)
                space, rank = space - x, rank + bins
            if space:
                if space not in room:
                    bisect.insort(spaces, space)
                room.setdefault(space, []).append((first, bins))


def _assign(plan: dict[str, np.ndarray]):
    """Map function: the sequence of each piece from its rank among the pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(plan["key"], (length << 44) + rank, side="right") - 1
            sequence = plan["base"][at] + (rank + plan["shift"][at]) // plan["per"][at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence)], names=[*names, "sequence_id"])

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, groups: int = 256, scratch: C.Scratch | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text. A document is the ids of its text in the byte-level BPE
    `vocabulary` (a path that every executor has), then end_id. Only a document of more than
    `capacity` ids is cut, so that all pieces but the first are full.

    sequence_id is any number: full pieces have negative ones. Null or empty text: the one id end_id. Repeated rows and null doc_ids are packed like any
    other row. An empty table gives no rows. Other columns are not read.
    """
    s = scratch or C.Scratch(docs.sparkSession, "packing")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = s.save(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_pieces(vocabulary, capacity, end_id), f"{schema}, counter bigint"))
    part = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}  # less than capacity rows
    plan = make_plan(counts, capacity, groups)
    # a rank is the rank within a share of the pieces of a length, and the number in the shares before it
    shares = sum(counts.values()) // RANKED + 1
    dealt = part.withColumn("share", F.pmod("counter", F.lit(shares)))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "share").count().select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "counter"))
    ranked = dealt.withColumn("nth", nth).join(offsets, ["length", "share"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_assign(plan.arrays()), f"{schema}, sequence_id bigint")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    full = pieces.where(F.col("length") == capacity).drop("counter").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return placed.union(full)
