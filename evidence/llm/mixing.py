"""Mixing sources to target weights: targets by source, repetition rates, whole copies and one seeded draw.

Only DataFrame functions are used. Texts are read twice, for the sizes of the sources and for the
copies; what is kept between is one row a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, placed, salted_join


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def source_targets(docs: DataFrame, scratch: Scratch, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """key, n_docs, source_size and target of each source.

    The sources, by code point with null last, have the weights in turn and divide `share` of all sizes among
    themselves in proportion to them. A target above `most` times its source's size stops there; the excess goes to the
    others by weight until none is above. Each step is one aggregate over the table of sources; two numbers come to the driver.
    """
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(_size()).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = scratch.save(placed(scratch.save(sources), [F.asc_nulls_last("source")], scratch).select(_key().alias("key"), "n_docs", "source_size", weight.alias("weight")))
    total, whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (total or 0)
    level, bounded = wanted / (whole or 1), -1
    while True:
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
        n, held, rest = table.agg(F.count_if(above), F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == bounded:
            break
        bounded, level = n, (wanted - (held or 0.0)) / (rest or 1)
    return table.select("key", "n_docs", "source_size", F.least(most * F.col("source_size"), F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _drawn(docs: DataFrame, carry: Sequence[str], weights: Sequence[int], share: float, most: float, seed: int) -> DataFrame:
    s = Scratch(docs.sparkSession, "mixing")
    own = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("none"), *carry).alias("extra"))
    targets = s.save(source_targets(own, s, weights, share, most))
    rows = own.select("doc_id", "extra", _key().alias("key"), _size().alias("size"), F.xxhash64("doc_id", "text").alias("by"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    out = salted_join(rows, targets, ["key"], "n_docs", F.col("by")).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("bigint"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 12) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, copies and taken.

    docs needs doc_id, text and source. size is the number of words. A source's rate is target / source_size; each of its
    documents has floor(rate) copies, and one more where a hash of seed and doc_id, as a number in [0, 1), is below the
    fraction of the rate. taken is copies * size, so no document exceeds ceil(most) times its size.

    Null or empty text: size 0. A null source is one of its own. A source without words has target 0 and no copies. Rows that
    agree in doc_id get one draw; a null doc_id is hashed as an empty one. An empty table gives an empty one. Other columns are not read.
    """
    out = _drawn(docs, (), weights, share, most, seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 12) -> DataFrame:
    """The mix itself: each row of docs as often as `mixed` says, with `copy` from 1 in place of a column of that name."""
    columns = [c for c in docs.columns if c != "copy"]
    out = _drawn(docs, columns, weights, share, most, seed).where(F.col("copies") > 0)
    return out.select(*(F.col(f"extra.`{c}`") for c in columns), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))


#: The same rows in SQL, with the default parameters.
SQL = r"""
with recursive d as (select doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) as size from documents),
s as (select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from d group by source),
lv as (select 0 as i, (sum(source_size) / sum(weight))::double as level from s union all
  select i + 1, ((select sum(source_size) from s) - coalesce(sum(3.0::double * source_size) filter (weight * level > 3 * source_size), 0)) / coalesce(sum(weight) filter (weight * level <= 3 * source_size), 1) from lv, s where i < 40 group by i, level),
t as (select source, source_size, least(3.0::double * source_size, weight * (select level from lv where i = 40))::double as target from s),
r as (select doc_id, size, source_size, target, case when source_size > 0 then least(3.0::double, target / source_size) else 0.0::double end as rate,
  ('0x' || substr(sha256('12:' || doc_id), 1, 8))::bigint / 4294967296::double as draw from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end)::bigint as copies,
  (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken from r
"""
