"""Which rows are meant: commitments of one's own, verified records, records of an owner, timelines, lists, counts of a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import place_of

Names = str | list[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def own_commitments(claims: DataFrame, category: Column, act: Column, chair: Column, required: Names, person: Column, kind: str = "STANCE_COMMITMENT", own: str = "OWN_STANCE") -> DataFrame:
    """Claims of a category and act, by persons who do not preside, with all required columns and a person that is not empty."""
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), _list(required), (person.cast("string") != "") & person.isNotNull())
    return claims.where((category == kind) & (act == own) & known & ~F.coalesce(chair, F.lit(False)))


def verified_records(rows: DataFrame, body: str, schema: T.StructType | str, verified: str, approved: str | None = None, approved_at: str | None = None, name: str = "record") -> DataFrame:
    """Rows whose flag `verified` is 1 (and `approved`, if given), with their JSON body parsed as `name` and the time of approval in it.

    A body that is no JSON object has a record of nulls.
    """
    good = F.col(verified).cast("int") == 1
    if approved:
        good = good & (F.col(approved).cast("int") == 1)
    record = F.from_json(body, schema if isinstance(schema, str) else schema.simpleString())
    if approved_at:
        record = record.withField("approvedAt", F.col(approved_at))
    return rows.where(good).withColumn(name, record).drop(body)


def by_owner(rows: DataFrame, owner: Names, owners: DataFrame) -> DataFrame:
    """Rows of some owners, a table of keys that may repeat; a null key owns nothing."""
    return rows.join(owners.select(*_list(owner)).distinct(), _list(owner), "left_semi")


def turn_lookup(records: DataFrame, turns: DataFrame, key: Names, columns: list[str]) -> DataFrame:
    """Records with the columns of their turn; a record without a turn goes, and of several turns of a key the least counts."""
    one = turns.groupBy(*_list(key)).agg(F.min(F.struct(*columns)).alias("_t"))
    return records.join(one, _list(key)).select(*records.columns, *[F.col(f"_t.{c}").alias(c) for c in columns])


def timeline(rows: DataFrame, entity: Names, order: list[str], name: str = "pos", width: float | None = None) -> DataFrame:
    """Rows with their place, from 1, among those of their entity in order; a long history is spread over tasks."""
    return place_of(rows, _list(entity), order, name, width)


def without(values: Column, *names: str) -> Column:
    """A list without some names, in order and each value once; null for a null list."""
    return F.array_sort(F.array_except(values, F.array(*map(F.lit, names))))


def concat_sources(tables: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """All rows of some tables with the name of their table; a column that a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in tables.items()])


def dataset_meta(rows: DataFrame, day: str, person: str, analysed: Column, annotations: Column, debate: str, ballot_day: Column) -> DataFrame:
    """One row: days, debates, messages, analysed messages, annotations, persons and ballot days, in one aggregate."""
    return rows.agg(
        F.count_distinct(day).alias("days"), F.count_distinct(debate).alias("debates"), F.count(F.lit(1)).alias("messages"), F.count_if(analysed).alias("analysed"),
        F.coalesce(F.sum(annotations), F.lit(0)).cast("bigint").alias("annotations"), F.count_distinct(person).alias("persons"), F.count_distinct(ballot_day).alias("ballot_days"),
    )
