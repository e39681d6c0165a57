"""What held at a time: interval, as-of and window joins, and checks of event order.

An interval has two inclusive ends, either of which may be null (open), unless a docstring
says otherwise. Joins have an equality on a key and on blocks of time (`intervals`), and ordered
scans go chunk by chunk (`scans`), so that one entity with a long history is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as blocks
from .scans import first_after, last_before

Names = str | list[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def within(at: Column, since: Column, until: Column) -> Column:
    """at lies in [since, until]; a null end is open."""
    return (since.isNull() | (at >= since)) & (until.isNull() | (at <= until))


def range_join(probes: DataFrame, intervals: DataFrame, key: Names, at: str, since: str, until: str) -> DataFrame:
    """Probes with each interval of their key that holds at the date `at`.

    Columns of the two sides must differ but for the key. A null key or date has no interval.
    """
    keys = _list(key)
    right = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in intervals.columns if c not in keys], F.explode(blocks.days(F.col(since), F.col(until))).alias("_block"))
    left = probes.select("*", F.explode(blocks.day(F.col(at))).alias("_in"))
    cond = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_in") == F.col("_block"), within(F.col(at), F.col(since), F.col(until))]
    return left.join(right, cond).drop(*[f"_{k}" for k in keys], "_block", "_in")


def _back(probes: DataFrame, found: DataFrame, columns: list[str], value: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """All probes, equal ones too, with the value found for their columns; only those named may be null in found."""
    right = found.select(*[F.col(c).alias(f"_{c}") for c in columns], value)
    same = [probes[c].eqNullSafe(right[f"_{c}"]) if c in nullable else probes[c] == right[f"_{c}"] for c in columns]
    return probes.join(right, same, "left").drop(*[f"_{c}" for c in columns])


def interval_at(probes: DataFrame, intervals: DataFrame, key: Names, at: str, value: str, seq: str, since: str = "since", until: str = "until") -> DataFrame:
    """Each probe with `value` of the first interval (by seq) that holds at its date, or null."""
    asked = [*_list(key), at]
    joined = range_join(probes.select(*asked), intervals.select(*_list(key), value, seq, since, until), key, at, since, until)
    return _back(probes, joined.groupBy(*asked).agg(F.min_by(value, seq).alias(value)), asked, value)


def fact_at(probes: DataFrame, facts: DataFrame, key: Names, at: str, value: str, since: str = "valid_from", until: str = "valid_to", seq: str | None = None) -> DataFrame:
    """Each probe with `value` of the fact with the latest start that holds at its date, nulls last.

    Equal starts go to the larger seq.
    """
    more = [seq] if seq else []
    asked = [*_list(key), at]
    joined = range_join(probes.select(*asked), facts.select(*_list(key), value, *more, since, until), key, at, since, until)
    latest = F.struct(F.col(since).isNotNull().alias("known"), F.col(since).alias("start"), *more)
    return _back(probes, joined.groupBy(*asked).agg(F.max_by(value, F.when(F.col(value).isNotNull(), latest)).alias(value)), asked, value)


def fact_for_object(probes: DataFrame, facts: DataFrame, key: Names, value: str, seq: str) -> DataFrame:
    """Each probe with `value` of one fact of its key: the first by seq."""
    one = facts.groupBy(*_list(key)).agg(F.min_by(value, seq).alias(value))
    return probes.join(one, _list(key), "left")


def excused(events: DataFrame, excuses: DataFrame, key: Names, minute: str, begin: str, end: str, name: str = "excused") -> DataFrame:
    """Events with a flag: an excuse of the key covers the minute, or the minute is null and the key has any.

    Excuses with a null end are skipped unless the minute is null.
    """
    keys = _list(key)
    asked = [*keys, minute]
    hit = F.when(F.col(minute).isNull(), True).otherwise(F.coalesce(F.col(minute).between(F.col(begin), F.col(end)), F.lit(False)))
    joined = events.select(*asked).join(excuses.select(*keys, begin, end, F.lit(1).alias("_any")), keys)
    found = _back(events, joined.groupBy(*asked).agg(F.max(hit).alias(name)), asked, name, nullable=(minute,))
    return found.withColumn(name, F.coalesce(name, F.lit(False)))


def context_window(messages: DataFrame, group: str, item: str, minute: str, text: str, width: int = 60, most: int = 500) -> DataFrame:
    """Pairs (item, other, gap, other_text) of one group at most `width` minutes apart.

    Both sides carry a time bucket of `width` minutes and meet in the same or a next bucket,
    so a group of n messages costs what its windows hold, not n squared.
    """
    known = messages.where(F.col(minute).isNotNull()).select(group, item, F.col(minute).alias("m"), text)
    left = known.select(group, item, "m", F.explode(F.array(*[F.floor(F.col("m") / width) + k for k in (-1, 0, 1)])).alias("bucket"))
    right = known.select(group, F.col(item).alias("other"), F.col("m").alias("om"), F.substring(text, 1, most).alias("other_text"), F.floor(F.col("m") / width).alias("bucket"))
    near = left.join(right, [group, "bucket"]).where((F.col(item) != F.col("other")) & (F.abs(F.col("m") - F.col("om")) <= width))
    return near.select(group, item, "other", F.abs(F.col("m") - F.col("om")).alias("gap"), "other_text")


def point_in_turn(points: DataFrame, turns: DataFrame, key: Names, at: str, start: str, end: str, value: str, width: float = 64.0) -> DataFrame:
    """Each point with `value` of the first turn with start <= at < end (half open), or null.

    Turns are cut into blocks of `width` seconds (or units) and their multiples; a turn of any length
    costs some ten rows for each factor of eight.
    """
    keys = _list(key)
    asked = [*keys, at]
    kind = points.schema[at].dataType.simpleString()
    number = (lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6) if kind.startswith(("timestamp", "date")) else (lambda c: F.col(c).cast("double"))
    unit = lambda c: F.floor(number(c) / width).cast("bigint")
    levels = 10
    right = turns.where(F.col(start) < F.col(end)).select(*[F.col(k).alias(f"_{k}") for k in keys], start, end, value, F.explode(blocks.cut(unit(start), unit(end), levels)).alias("_block"))
    left = points.select(*asked, F.explode(blocks.holders(unit(at), levels)).alias("_in"))
    cond = [left[k] == right[f"_{k}"] for k in keys] + [left["_in"] == right["_block"], left[at] >= right[start], left[at] < right[end]]
    found = left.join(right, cond).groupBy(*[left[c] for c in asked]).agg(F.min_by(right[value], right[start]).alias(value))
    return _back(points, found, asked, value)


def latest_before(events: DataFrame, marks: DataFrame, key: Names, at: str, mark_at: str, value: str, inclusive: bool = True, width: float | None = None) -> DataFrame:
    """Each event with `value` of the last mark at or before it, or null: one union and one scan, no range join."""
    kind = marks.schema[value].dataType
    own = [c for c in events.columns if c != value]
    left = events.select(*own, F.col(at).alias("_t"), F.lit(1).alias("_r"), F.lit(None).cast(kind).alias("_v"))
    right = marks.select(*_list(key), F.col(mark_at).alias("_t"), F.lit(0 if inclusive else 2).alias("_r"), F.col(value).alias("_v"))
    found = last_before(left.unionByName(right, allowMissingColumns=True), _list(key), ["_t", "_r"], F.col("_v"), value, width=width)
    return found.where("_r = 1").select(*own, value)


def recordings(days: DataFrame, records: DataFrame, key: Names, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Days with their recording's columns (null without), and the days that have none."""
    keys = _list(key)
    right = records.select(*keys, *columns)
    return days.join(right, keys, "left"), days.join(right, keys, "left_anti")


def year_ago(series: DataFrame, day: str, value: str, shift: Column) -> DataFrame:
    """Each value with the one at the shifted date, their difference (2 digits) and its direction."""
    past = series.select(shift.alias(day), F.col(value).alias("past"))
    diff = F.round(F.col(value) - F.col("past"), 2)
    direction = F.when(diff > 0, "up").when(diff < 0, "down").when(diff == 0, "same")
    return series.join(past, day).select(day, value, "past", diff.alias("diff"), direction.alias("direction"))


def neighbours(events: DataFrame, key: Names, order: list[str], at: str, width: float | None = None) -> DataFrame:
    """Previous and next time of each event of its key; without a next one an hour later."""
    time = F.struct(F.col(at).alias("at"))
    both = first_after(last_before(events, _list(key), order, time, "_prev", own=False, width=width), _list(key), order, time, "_next", width=width)
    return both.select(*events.columns, F.col("_prev.at").alias("prev_at"), F.coalesce(F.col("_next.at"), F.col(at) + F.expr("interval 1 hour")).alias("next_at"))


def order_check(events: DataFrame, key: Names, order: list[str], second: str, width: float | None = None) -> DataFrame:
    """Verdict on each event's second against the last timed one before: ok, rounding (<= 60 s back), problem, missing."""
    back = F.col("_last") - F.col(second)
    verdict = F.when(F.col(second).isNull(), "missing").when(back > 60, "problem").when(back > 0, "rounding").otherwise("ok")
    return last_before(events, _list(key), order, F.col(second), "_last", own=False, width=width).withColumn("verdict", verdict).drop("_last")


def within_window(events: DataFrame, second: str, start: str, following: str) -> DataFrame:
    """Whether a second of the day falls in [start - 120, following + 120]; before it, a day is added; no following: start + 3600."""
    at = F.when(F.col(second) < F.col(start) - 120, F.col(second) + 86400).otherwise(F.col(second))
    end = F.coalesce(F.col(following), F.col(start) + 3600)
    return events.withColumn("in_window", at.between(F.col(start) - 120, end + 120))


def carry_forward(rows: DataFrame, key: Names, order: list[str], marker: str, default: Column, name: str, width: float | None = None) -> DataFrame:
    """The last marker at or before each row of its key, or the default."""
    return last_before(rows, _list(key), order, F.col(marker), "_kept", width=width).withColumn(name, F.coalesce("_kept", default)).drop("_kept")


def media_offset(rows: DataFrame, clock: str, start: str, char_start: str, exact: str, chars_per_second: float = 14.5) -> DataFrame:
    """Offset of a clock second in a stream: negative or null is UNPAIRED.

    second is the exact one where known, else the offset plus the characters before it.
    """
    offset = F.when(F.col(clock) - F.col(start) >= 0, F.col(clock) - F.col(start))
    return rows.select(
        "*",
        offset.alias("offset_s"),
        F.when(offset.isNull(), "UNPAIRED").otherwise("OFFSET_SYNC").alias("pairing"),
        F.coalesce(F.col(exact), (offset + F.round(F.col(char_start) / chars_per_second)).cast("bigint")).alias("second"),
    )
