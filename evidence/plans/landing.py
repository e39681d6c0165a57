"""What is written and read back: the nested dataset, request lines, guarded paths, merged batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources import files, sinks
from ..streaming import upsert
from .registry import Tables, query


@query("""with m as (select conv_id, turn, role, text, turn % 3 = 0 as analysed, case when contains(text, ' the ') then len(role) else 0 end as notes from conversations)
  select conv_id, count(*)::integer as n_messages, coalesce(sum(len(text)), 0)::bigint as characters, (select count(distinct conv_id) from m) as debate_count, (select count(*) from m) as message_count,
    (select count(*) from m where analysed) as analysed_count, (select sum(notes) from m)::bigint as annotation_count, (select count(*) from customer) as person_count, (select count(*) from nation) as party_count
  from m group by conv_id""")
def write_dataset(t: Tables) -> DataFrame:
    """The nested dataset written in one commit, and what its sections and meta say."""
    c = t.conversations
    notes = F.when(F.col("text").contains(" the "), F.transform(F.sequence(F.lit(1), F.length("role")), lambda i: F.concat(F.lit("n"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    row = F.struct("turn", "role", "text", F.col("text").alias("rawText"), F.when(F.col("turn") % 3 == 0, "engine").alias("analyzedAt"), notes.alias("annotations"))
    debates = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("messages"))
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    parties = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    path = files.shared_path(t.spark, "dataset")
    sinks.write_document(sinks.dataset(debates, people, parties), path, public="/public", meta={"term": "10"})
    meta = sinks.manifest(t.spark, path)["meta"]
    read = sinks.read_section(t.spark, path, "debates", "conv_id bigint, messages array<struct<turn: bigint, text: string, rawText: string>>")
    length = F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.length(m["text"]), F.lit(0)) + F.coalesce(F.length(m["rawText"]), F.lit(0)))
    named = {"debate_count": "debateCount", "message_count": "messageCount", "analysed_count": "analyzedMessageCount", "annotation_count": "annotationCount", "person_count": "personCount", "party_count": "partyCount"}
    return read.select("conv_id", F.size("messages").alias("n_messages"), length.alias("characters"), *[F.lit(meta.get(v, 0)).cast("bigint").alias(k) for k, v in named.items()])


@query("""select distinct sha256('judge::v2::' || text) as cache_key, 'judge' as role, 'base' as model, len(text)::integer as characters from documents
  where text is not null and doc_id % 4 <> 0 and sha256('judge::v2::' || text) not in (select sha256('judge::v2::' || text) from documents where text is not null and doc_id % 4 = 0)""")
def model_requests(t: Tables) -> DataFrame:
    """What is not cached is written as request lines, in two rounds that share some, and read back once each."""
    d = t.documents.where("text is not null").select("doc_id", "text", X.stable_key(F.lit("judge"), F.lit("v2"), F.col("text")).alias("cache_key"))
    pending = d.where("doc_id % 4 <> 0").join(d.where("doc_id % 4 = 0").select("cache_key").distinct(), "cache_key", "left_anti")
    asked = pending.select("doc_id", "cache_key", F.lit("judge").alias("role"), F.lit("base").alias("model"), F.lit("Say what is claimed.").alias("system"), F.col("text").alias("user"))
    path = files.shared_path(t.spark, "requests")
    sinks.write_requests(asked.where("doc_id % 3 > 0"), path)
    sinks.write_requests(asked.where("doc_id % 3 < 2"), path)
    return sinks.read_requests(t.spark, path).select("cache_key", "role", "model", F.length("user").alias("characters"))


@query("""with p as (select page_id, regexp_replace(url, '^https?:/', '') as path, page_id % 2 = 0 as internal from pages)
  select page_id, not (internal and starts_with(regexp_replace(path || '/', '/+', '/', 'g'), '/' || (select min(split_part(url, '/', 3)) from pages) || '/')) as may_stand from p""")
def write_guard(t: Tables) -> DataFrame:
    """Which pages could be written where they stand, if the first host is public and every second page internal."""
    host = t.pages.agg(F.min(F.split_part("url", F.lit("/"), F.lit(3)))).first()[0]
    p = t.pages.select("page_id", F.regexp_replace("url", "^https?:/", "").alias("path"), (F.col("page_id") % 2 == 0).alias("internal"))
    return p.select("page_id", sinks.may_stand(F.col("path"), f"/{host}", F.col("internal")).alias("may_stand"))


@query("""with u as (select o_orderkey, o_custkey, o_totalprice, 1 as batch from orders union all select o_orderkey, o_custkey + 1, o_totalprice * 2, 2 from orders where o_orderkey % 3 = 0
    union all select o_orderkey + 10000000, o_custkey, o_totalprice, 3 from orders where o_orderkey % 7 = 0)
  select o_orderkey, o_custkey, o_totalprice, batch from (select *, row_number() over (partition by o_orderkey order by batch desc) as k from u) where k = 1""")
def incremental_upsert(t: Tables) -> DataFrame:
    """Orders that land in three batches and are merged by a stream into a versioned table."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    landed = [o.withColumn("batch", F.lit(1)), o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_custkey") + 1, F.col("o_totalprice") * 2, F.lit(2)), o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey") + 10_000_000, "o_custkey", "o_totalprice", F.lit(3))]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in landed[0].schema])
    root = files.shared_path(t.spark, "upsert")
    for rows in landed:
        rows.toDF(*schema.names).write.mode("append").parquet(f"{root}/landed")
        upsert.incremental_upsert(t.spark, f"{root}/landed", schema, f"{root}/table", ["o_orderkey"], "batch", f"{root}/checkpoint", buckets=8).awaitTermination()
    return upsert.current(t.spark, f"{root}/table", schema, ["o_orderkey"], "batch")
