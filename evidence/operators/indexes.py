"""Indexes, registers, tallies and orders over persons, groups and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..sources.files import saved

Names = str | list[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def speech_metrics(rows: DataFrame, key: Names, length: str, short: int = 200, least: int = 5) -> DataFrame:
    """By key with at least `least` rows: count, exact median length (one digit), share below `short` (four)."""
    out = rows.groupBy(*_list(key)).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(length, 0.5), 1).alias("median"), F.round(F.avg(F.when(F.col(length) < short, 1.0).otherwise(0.0)), 4).alias("short_share"))
    return out.where(F.col("n") >= least)


def min_sample(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Counts by key, with a flag where a metric may be shown."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("shown", F.col("n") >= least)


def substance_index(persons: DataFrame, bills: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Listed persons with bills (0 without) and metrics; those with neither are left out."""
    out = persons.select(key).distinct().join(bills, key, "left").join(metrics, key, "left")
    return out.where(F.col("bills").isNotNull() | F.col("n").isNotNull()).withColumn("bills", F.coalesce("bills", F.lit(0)))


def consistency(commitments: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """By person on either side: commitments, scores of the two upper tiers, those from 0.80, index, label."""
    n = commitments.groupBy(key).agg(F.count(F.lit(1)).alias("commitments"))
    upper = scores.where(S.presentation_tier(F.col(score)) != "DROPPED").groupBy(key).agg(F.count(F.lit(1)).alias("findings"))
    out = n.join(upper, key, "full").withColumn("commitments", F.coalesce("commitments", F.lit(0))).withColumn("findings", F.coalesce("findings", F.lit(0)))
    out = out.withColumn("sci", S.consistency_index(F.col("commitments"), F.col("findings")))
    return out.withColumn("label", S.index_label(F.col("sci")))


def party_rollup(persons: DataFrame, key: str, party: str, value: str) -> DataFrame:
    """Persons with the mean of their party (members without a value left out, none at all: 1.0) and their distance from it."""
    means = persons.where(F.col(party) != "").groupBy(party).agg(F.round(F.coalesce(F.avg(value), F.lit(1.0)), 4).alias("party_mean"), F.count(F.lit(1)).alias("members"))
    return persons.join(means, party).select(key, party, value, "party_mean", "members", F.round(F.col(value) - F.col("party_mean"), 4).alias("delta"))


def mode_per_group(rows: DataFrame, key: Names, item: str, tie: Column, least_first: bool = False) -> DataFrame:
    """The most frequent item of each key; ties by the aggregate `tie`: the largest, or the least."""
    counts = rows.groupBy(*_list(key), item).agg(F.count(F.lit(1)).alias("n"), tie.alias("_tie"))
    w = Window.partitionBy(*_list(key)).orderBy(F.desc("n"), F.asc("_tie") if least_first else F.desc("_tie"))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_tie")


def latest_non_null(rows: DataFrame, key: Names, value: str, order: list[str]) -> DataFrame:
    """The last value by order that is neither null nor empty."""
    usable = F.col(value).isNotNull() & (F.col(value).cast("string") != "")
    return rows.groupBy(*_list(key)).agg(F.max_by(value, F.when(usable, F.struct(*order))).alias(value))


def person_register(messages: DataFrame, name: str, role: str, group: str, order: list[str], slug: Column) -> DataFrame:
    """By name: messages, most frequent role (ties: the larger), latest time, latest group that is not empty, and a slug.

    A slug that several names share gets the rank of the name appended, from the second on.
    """
    base = messages.groupBy(name).agg(F.count(F.lit(1)).alias("messages"), F.max(order[0]).alias("latest"))
    roles = mode_per_group(messages, name, role, F.max(role)).select(name, role)
    out = base.join(roles, name).join(latest_non_null(messages, name, group, order), name).withColumn("slug", slug)
    n = F.row_number().over(Window.partitionBy("slug").orderBy(name))
    return out.withColumn("_n", n).withColumn("slug", F.when(F.col("_n") > 1, F.concat_ws("-", "slug", F.col("_n").cast("string"))).otherwise(F.col("slug"))).drop("_n")


def state_tally(states: DataFrame, key: str, state: str, names: Sequence[str], unchecked: str) -> DataFrame:
    """Counts of each state by key, those checked, and the share of each state in these (0 without)."""
    counts = [F.count_if(F.col(state) == x).alias(x) for x in names]
    out = states.groupBy(key).agg(*counts).withColumn("checked", sum((F.col(x) for x in names if x != unchecked), F.lit(0).cast("bigint")))
    for x in names:
        if x != unchecked:
            out = out.withColumn(f"{x}_share", F.when(F.col("checked") > 0, F.round(100 * F.col(x) / F.col("checked"))).otherwise(0.0))
    return out


def downsample(rows: DataFrame, key: str, order: list[str], priority: str, most: int = 180) -> DataFrame:
    """At most `most` buckets of consecutive rows by key, each with its smallest priority."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bucket = F.floor((F.row_number().over(w) - 1) / F.ceil(n / most))
    return rows.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.min(priority).alias(priority), F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, kind: str, example: str, seq: str) -> DataFrame:
    """Counts and percentages by class, with the first example by seq."""
    out = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min_by(example, seq).alias("example"))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("total"), 2)).drop("total")


def speaker_groups(segments: DataFrame, speaker: str, at: str, seconds: str, text: str, most: int = 300) -> DataFrame:
    """By speaker: total seconds and the first characters of the texts in time order.

    Each text but the last adds a separator at least, so that only the first most + 1 can be seen; each task
    keeps these (a limit within the window, for most < 1000) before anything is shuffled.
    """
    rows = segments.where(F.col(speaker).isNotNull())
    texts = rows.where(F.col(text).isNotNull()).select(speaker, at, F.substring(text, 1, most).alias(text))
    first = texts.withColumn("_r", F.row_number().over(Window.partitionBy(speaker).orderBy(at, text))).where(F.col("_r") <= most + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), " ")
    seen = first.groupBy(speaker).agg(F.substring(joined, 1, most).alias("_text"))
    out = rows.groupBy(speaker).agg(F.sum(seconds).alias("seconds")).join(seen, speaker, "left")
    return out.select(speaker, "seconds", F.coalesce("_text", F.lit("")).alias("text"))


def first_per_group(rows: DataFrame, key: Names, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*_list(key)).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dense_block_index(rows: DataFrame, key: str, title: str, pos: str) -> DataFrame:
    """Rows with the number of their title's first appearance in the key."""
    first = F.min(pos).over(Window.partitionBy(key, title))
    return rows.withColumn("_first", first).withColumn("block", F.dense_rank().over(Window.partitionBy(key).orderBy("_first"))).drop("_first")


def facet_counts(rows: DataFrame, kind: str) -> DataFrame:
    """Counts by kind, and of all rows as kind 'all'."""
    return rows.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.grouping(kind).alias("_all")).select(F.when(F.col("_all") == 1, "all").otherwise(F.col(kind)).alias(kind), "n")


def ranked(rows: DataFrame, columns: Sequence[str], order: list[Column]) -> DataFrame:
    """Rows with their place in an order.

    The place comes from counts of sorted range partitions, so that no single task sorts all rows. They are written
    once: bounds of ranges come from a sample that each evaluation draws anew, and counts of other ranges give other places.
    """
    parts = rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    parts = saved(parts, "ranked")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return parts.join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + F.col("_k") + 1).drop("_p", "_k", "_before")


def bill_lookup(asked: DataFrame, bills: DataFrame, organ: str, number: str, seq: str, value: str) -> DataFrame:
    """Each (organ, number) with the value of that bill, else of the first bill of the number in any organ."""
    exact = bills.groupBy(organ, number).agg(F.min_by(value, seq).alias("_exact"))
    fallback = bills.groupBy(number).agg(F.min_by(value, seq).alias("_any"))
    out = asked.join(exact, [organ, number], "left").join(fallback, number, "left")
    return out.select(*asked.columns, F.coalesce("_exact", "_any").alias(value), F.col("_exact").isNotNull().alias("exact"))


def identity(asked: DataFrame, people: DataFrame, name: str, year: str, born: str, person: str) -> DataFrame:
    """The person for a name in any case: the only candidate, else the first whose birth year contains the year, else null."""
    key = F.lower(F.btrim(F.col(name)))
    known = people.select(key.alias("_key"), person, F.col(born).cast("string").alias("_born"))
    counts = known.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(person).alias("_only"))
    every, asked = asked, asked.select(name, year).distinct()
    matched = asked.withColumn("_key", key).join(counts, "_key", "left").join(known, "_key", "left")
    fits = F.when(F.col("_born").contains(F.col(year).cast("string")), F.col(person))
    out = matched.groupBy(*asked.columns, "_n", "_only").agg(F.min(fits).alias("_fit"))
    found = out.select(F.col(name).alias("_name"), F.col(year).alias("_year"), F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_fit")).alias(person))
    return every.join(found, every[name].eqNullSafe(found["_name"]) & every[year].eqNullSafe(found["_year"]), "left").drop("_name", "_year")
