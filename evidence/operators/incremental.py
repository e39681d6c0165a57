"""Upserts, partition replacement, decisions, caches and pending requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = str | list[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def upsert_latest(old: DataFrame, new: DataFrame, key: Names, batch: str) -> DataFrame:
    """Both tables with one row a key: the one of the latest batch; within a batch the largest row.

    A partial aggregation keeps one row a key before the shuffle.
    """
    keys = _list(key)
    rest = [c for c in old.columns if c not in keys]
    best = F.max(F.struct(batch, *[c for c in rest if c != batch])).alias("r")
    out = old.unionByName(new).groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in old.columns])


def upsert_preserving(old: DataFrame, new: DataFrame, key: Names, keep: list[str]) -> DataFrame:
    """New rows replace old ones, but for the columns `keep`, which stay where the old row had them."""
    keys = _list(key)
    kept = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    merged = new.join(kept, keys, "left")
    for c in keep:
        merged = merged.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return merged.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti"))


def replace_partition(new: DataFrame, path: str, partition: str) -> None:
    """Overwrite the partitions that new has, whole and no others; a repeated call changes nothing."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def apply_status(rows: DataFrame, decisions: DataFrame, key: Names, status: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the decided status where there is a decision, and the decisions of unknown keys."""
    keys = _list(key)
    new = decisions.select(*keys, F.col(status).alias("_new"))
    done = rows.join(new, keys, "left").withColumn(status, F.coalesce("_new", status)).drop("_new")
    return done.select(*rows.columns), decisions.join(rows.select(*keys).distinct(), keys, "left_anti")


def ttl_lookup(asked: DataFrame, cache: DataFrame, key: Names, stored: str, value: str, now: Column, seconds: int) -> DataFrame:
    """Each asked key with the value of the cache if it is not older than `seconds`, and whether it hit."""
    fresh = F.col(stored).isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp(stored) <= seconds)
    out = asked.join(cache.select(*_list(key), stored, value), _list(key), "left")
    return out.select(*asked.columns, F.when(fresh, F.col(value)).alias(value), F.coalesce(fresh, F.lit(False)).alias("hit"))


def call_plan(requests: DataFrame, cache: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Each distinct request with its state: cached, answered, or pending; role and prompt version are part of the key."""
    one = requests.dropDuplicates([key])
    out = one.join(cache.select(key, F.lit(True).alias("_c")).distinct(), key, "left").join(answers.select(key, F.lit(True).alias("_a")).distinct(), key, "left")
    return out.withColumn("state", F.when(F.col("_c"), "cached").when(F.col("_a"), "answered").otherwise("pending")).drop("_c", "_a")


def lead_queue(pairs: DataFrame, claims: DataFrame, profiles: DataFrame, low: float, high: float, similarity: float) -> DataFrame:
    """Pairs in a band of contradiction, with both claims' texts and the speaker's profile (null where unknown).

    Both claims must exist and stand in different messages.
    """
    band = pairs.where((F.col("contradiction") >= low) & (F.col("contradiction") < high) & (F.col("similarity") >= similarity))
    a = claims.select(F.col("claim_id").alias("a"), F.col("message_id").alias("a_message"), F.col("text").alias("a_text"), "person")
    b = claims.select(F.col("claim_id").alias("b"), F.col("message_id").alias("b_message"), F.col("text").alias("b_text"))
    return band.join(a, "a").join(b, "b").where(F.col("a_message") != F.col("b_message")).join(profiles, "person", "left")
