"""Row filters bound to documents, events, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import selections as S
from .registry import Tables, query


@query("select doc_id, n_chars from documents where len(text) >= 200 and not coalesce(source = 'src1', false)")
def substantive_filter(t: Tables) -> DataFrame:
    return R.substantive(t.documents, "text", F.col("source") == "src1").select("doc_id", "n_chars")


@query("select event_id, user_id from events where event_type = 'purchase' and value >= 50 and event_id % 10 <> 0 and user_id is not null and props is not null and ts is not null")
def own_commitment_filter(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "STANCE_COMMITMENT").otherwise("FACTUAL_CLAIM")
    act = F.when(F.col("value") >= 50, "OWN_STANCE").otherwise("QUOTED")
    return S.own_commitments(t.events, kind, act, F.col("event_id") % 10 == 0, ["ts", "props"], F.col("user_id")).select("event_id", "user_id")


@query("select doc_id from documents where coalesce(lang <> 'es', true) and not coalesce(regexp_matches(lower(text), 'was the|of the tion|que la'), false)")
def procedural_filter(t: Tables) -> DataFrame:
    return R.without_phrases(t.documents, F.col("text"), ("was the", "of the tion", "que la"), F.col("lang") == "es").select("doc_id")


@query("select conv_id, turn, case when role = 'user' or role is null then len(text) else 0 end as shown from conversations")
def attributable_only(t: Tables) -> DataFrame:
    own = F.col("role").isNull() | (F.col("role") == "user")
    found = F.when(own, F.split("text", "")).otherwise(F.array().cast("array<string>"))
    return t.conversations.select("conv_id", "turn", F.when(own, F.length("text")).otherwise(F.size(found)).cast("bigint").alias("shown"))


@query("select s_suppkey, s_name from supplier join nation on s_nationkey = n_nationkey where contains(lower(s_name || ' ' || n_name), 'nation_1')")
def text_search(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return R.search(s, " NATION_1 ", ["s_name", "n_name"]).select("s_suppkey", "s_name")


@query("select o_orderkey, o_custkey as person, o_orderpriority as kind, o_orderdate::date::varchar as approved_at from orders where o_orderstatus = 'F' and o_orderpriority <> '5-LOW'")
def verified_records(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.col("o_custkey").alias("person"), F.struct(F.col("o_orderpriority").alias("kind")).alias("what")))
    flags = t.orders.select("o_orderkey", body.alias("body"), (F.col("o_orderstatus") == "F").alias("verified"), (F.col("o_orderpriority") != "5-LOW").alias("approved"), F.to_date("o_orderdate").cast("string").alias("at"))
    r = S.verified_records(flags, "body", "person bigint, what struct<kind: string>", "verified", "approved", "at")
    return r.select("o_orderkey", "record.person", "record.what.kind", F.col("record.approvedAt").alias("approved_at"))


@query("select o_orderkey, o_custkey, o_totalprice from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def by_owner(t: Tables) -> DataFrame:
    return S.by_owner(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))).select("o_orderkey", "o_custkey", "o_totalprice")
