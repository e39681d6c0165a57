"""Indexes, registers and orders bound to documents, events, orders, customers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import enrichment as R
from ..operators import indexes as I
from ..operators import selections as L
from .registry import Tables, query


@query("""select source, lang, count(*) as n, round(quantile_cont(n_chars, 0.5), 1) as median, round(avg(case when n_chars < 1000 then 1.0 else 0.0 end), 4) as short_share
  from documents group by all having count(*) >= 5""")
def speech_metrics(t: Tables) -> DataFrame:
    return I.speech_metrics(t.documents, ["source", "lang"], "n_chars", 1000)


@query("select o_custkey, count(*) as n, count(*) >= 12 as shown from orders group by o_custkey")
def min_sample_gate(t: Tables) -> DataFrame:
    return I.min_sample(t.orders, "o_custkey", 12)


@query("""with b as (select c_custkey, count(*) as bills from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' group by 1),
  m as (select o_custkey as c_custkey, count(*) as n from orders group by 1 having count(*) >= 14)
  select c_custkey, coalesce(bills, 0) as bills, n from customer left join b using (c_custkey) left join m using (c_custkey) where bills is not null or n is not null""")
def substance_index(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    bills = o.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("bills"))
    metrics = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 14")
    return I.substance_index(t.customer, bills, metrics, "c_custkey")


SCI_SQL = """n as (select user_id, count(*) as c from events where event_type = 'purchase' group by 1),
  u as (select user_id, count(*) as f from events where event_type = 'view' and least(value / 100, 1.0) >= 0.80 group by 1),
  i as (select coalesce(n.user_id, u.user_id) as user_id, coalesce(c, 0) as commitments, coalesce(f, 0) as findings,
    round(case when coalesce(c, 0) <= 0 then 1.0 else greatest(0.0, least(1.0, 1.0 - coalesce(f, 0) / c)) end, 4) as sci from n full join u on n.user_id = u.user_id)"""


def _consistency(t: Tables) -> DataFrame:
    scores = t.events.where("event_type = 'view'").select("user_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))
    return I.consistency(t.events.where("event_type = 'purchase'"), scores, "user_id", "score")


@query(f"with {SCI_SQL} select user_id, commitments, findings, sci, case when sci >= 0.95 then 'consistent' when sci >= 0.85 then 'mostly consistent' when sci >= 0.70 then 'mixed' else 'inconsistent' end as label from i")
def consistency_index(t: Tables) -> DataFrame:
    return _consistency(t)


@query("""with m as (select c_mktsegment, round(avg(c_acctbal), 4) as party_mean, count(*) as members from customer group by 1)
  select c_custkey, c_mktsegment, c_acctbal, party_mean, members, round(c_acctbal - party_mean, 4) as delta from customer join m using (c_mktsegment)""")
def party_rollup(t: Tables) -> DataFrame:
    return I.party_rollup(t.customer, "c_custkey", "c_mktsegment", "c_acctbal")


@query("""with c as (select role as name, conv_id % 5 as role_no, count(*) as n from conversations group by all),
    r as (select name, role_no, row_number() over (partition by name order by n desc, role_no desc) as k from c),
    b as (select role as name, count(*) as messages, max(conv_id) as latest, arg_max(case when turn % 3 = 0 then 'club' || conv_id % 7 end, struct_pack(a := conv_id, b := turn)) filter (where turn % 3 = 0) as party from conversations group by 1)
  select b.name, messages, role_no, latest, party, case b.name when 'user' then 's-2' else 's' || case b.name when 'system' then '' else '' end end as slug from b join r on r.name = b.name and k = 1 where b.name <> 'system'""")
def person_register(t: Tables) -> DataFrame:
    m = t.conversations.where("role <> 'system'").select(F.col("role").alias("name"), (F.col("conv_id") % 5).alias("role_no"), "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("club"), (F.col("conv_id") % 7).cast("string"))).alias("party"))
    return I.person_register(m, "name", "role_no", "party", ["conv_id", "turn"], X.slugify(F.lit("S"))).select("name", "messages", "role_no", "latest", "party", "slug")


@query("""with s as (select source, case when l.doc_id is null then 'unchecked' when toxic = 1 then 'contradiction' when quality = 0 then 'shift' else 'clean' end as state from documents d left join labels l using (doc_id)),
  c as (select source, count(*) filter (where state = 'contradiction') as contradiction, count(*) filter (where state = 'shift') as shift, count(*) filter (where state = 'clean') as clean, count(*) filter (where state = 'unchecked') as unchecked from s group by source)
  select source, contradiction, shift, clean, unchecked, contradiction + shift + clean as checked, case when contradiction + shift + clean > 0 then round(100 * contradiction / (contradiction + shift + clean)) else 0.0 end as contradiction_share,
    case when contradiction + shift + clean > 0 then round(100 * shift / (contradiction + shift + clean)) else 0.0 end as shift_share, case when contradiction + shift + clean > 0 then round(100 * clean / (contradiction + shift + clean)) else 0.0 end as clean_share from c""")
def state_tally(t: Tables) -> DataFrame:
    s = t.documents.join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    state = F.when(F.col("known").isNull(), "unchecked").when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 0, "shift").otherwise("clean")
    return I.state_tally(s.withColumn("state", state), "source", "state", ["contradiction", "shift", "clean", "unchecked"], "unchecked")


@query("""with r as (select user_id, case event_type when 'error' then 0 when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 else 4 end as state, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as n from events)
  select user_id, floor((rn - 1) / ceil(n / 20))::bigint as bucket, min(state) as state, count(*) as n from r group by all""")
def tally_downsample(t: Tables) -> DataFrame:
    state = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    return I.downsample(t.events.withColumn("state", state), "user_id", ["ts", "event_id"], "state", 20)


@query("select case when starts_with(o_orderpriority, '1-') then 'engine' else 'hand' end as producer, count(*) as n from orders where o_orderstatus = 'F' group by 1")
def provenance_count(t: Tables) -> DataFrame:
    return E.provenance_count(t.orders.where("o_orderstatus = 'F'"), F.col("o_orderpriority").startswith("1-"))


@query("""select count(distinct o_orderdate) as days, count(distinct o_orderpriority) as debates, count(*) as messages, count(*) filter (where o_orderstatus = 'F') as analysed, sum(o_orderkey % 3)::bigint as annotations,
  count(distinct o_custkey) as persons, count(distinct case when o_orderstatus = 'F' then o_orderdate end) as ballot_days from orders""")
def dataset_meta(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return L.dataset_meta(t.orders, "o_orderdate", "o_custkey", done, F.col("o_orderkey") % 3, "o_orderpriority", F.when(done, F.col("o_orderdate")))


@query("select o_orderstatus, count(*) as n, arg_min(o_orderpriority, o_orderkey) as example, round(100 * count(*) / (select count(*) from orders), 2) as percent from orders group by 1")
def tier_report(t: Tables) -> DataFrame:
    return I.class_report(t.orders, "o_orderstatus", "o_orderpriority", "o_orderkey")


@query("""select event_type, count(*) as n, count(*) filter (where value >= 95) as published, count(*) filter (where value >= 80 and value < 95) as context, count(*) filter (where value < 80) as rejected,
  round(avg(case when value >= 80 then value end), 4) as mean_confidence from events group by 1""")
def annotation_stats(t: Tables) -> DataFrame:
    return E.annotation_stats(t.events, "event_type", F.col("value"), 95, 80)


@query("""select role, sum(turn)::bigint as seconds, substr(string_agg(text, ' ' order by conv_id * 100 + turn, text), 1, 300) as text from conversations where role is not null group by role""")
def speaker_groups(t: Tables) -> DataFrame:
    s = t.conversations.select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("at"), "turn", "text")
    return I.speaker_groups(s, "role", "at", "turn", "text")


@query("select lang, count(*) as documents, sum(len(text))::bigint as characters, count(distinct source) as sources from documents group by lang")
def text_stats(t: Tables) -> DataFrame:
    return E.text_stats(t.documents, "lang", "text", "source")


@query("select p_name, min(p_partkey) as p_partkey, arg_min(p_brand, p_partkey) as p_brand from part group by p_name")
def distinct_entities(t: Tables) -> DataFrame:
    return I.first_per_group(t.part, "p_name", [F.col("p_partkey")]).select("p_name", "p_partkey", "p_brand")


@query("""with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type desc) as k from c) where k = 1""")
def mode_per_group(t: Tables) -> DataFrame:
    return I.mode_per_group(t.events, "user_id", "event_type", F.max("event_type"))


@query("select user_id, arg_max(props, struct_pack(a := ts, b := event_id)) filter (where event_type = 'view') as props from events group by user_id")
def latest_non_null(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "view", F.col("props")).alias("props"))
    return I.latest_non_null(e, "user_id", "props", ["ts", "event_id"])


@query("""select conv_id, turn, dense_rank() over (partition by conv_id order by f)::integer as block from (select *, min(turn) over (partition by conv_id, role) as f from conversations)""")
def dense_block_index(t: Tables) -> DataFrame:
    return I.dense_block_index(t.conversations, "conv_id", "role", "turn").select("conv_id", "turn", "block")


@query("select event_type, user_id, event_id from (select *, row_number() over (partition by event_type order by ts, event_id) as k from events) where k = 1")
def first_per_group(t: Tables) -> DataFrame:
    return I.first_per_group(t.events, "event_type", [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::integer as pos from events")
def timeline(t: Tables) -> DataFrame:
    return L.timeline(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("pos").cast("int").alias("pos"))


@query("select coalesce(event_type, 'all') as event_type, count(*) as n from events group by rollup(event_type)")
def category_facets(t: Tables) -> DataFrame:
    return I.facet_counts(t.events, "event_type")


@query("select o_orderkey, o_orderpriority, o_totalprice, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as place from orders")
def sort_by_severity(t: Tables) -> DataFrame:
    return I.ranked(t.orders, ["o_orderkey", "o_orderpriority", "o_totalprice"], [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("select c_custkey, c_name, row_number() over (order by regexp_replace(c_name, '^[^#]*#', ''), c_custkey) as place from customer")
def register_sorts(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", F.regexp_replace("c_name", "^[^#]*#", "").alias("surname"))
    return I.ranked(c, ["c_custkey", "c_name", "surname"], [F.asc("surname"), F.asc("c_custkey")]).drop("surname")


@query("select o_orderkey, o_orderdate::date as d, row_number() over (order by o_orderdate desc, o_orderkey) as place from orders")
def ordered_lists(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return I.ranked(o, ["o_orderkey", "d"], [F.desc("d"), F.asc("o_orderkey")])


@query("""select user_id, string_agg(event_type, ',' order by f) as kinds from (select *, row_number() over (partition by user_id order by f) as k from (select user_id, event_type, min(event_id) as f from events group by all)) where k <= 3 group by user_id""")
def first_k_array(t: Tables) -> DataFrame:
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).groupBy("user_id").agg(F.array_join(F.slice(kinds, 1, 3), ",").alias("kinds"))


@query("select coalesce(a.k, b.k) as k from (select distinct o_custkey as k from orders where o_orderstatus = 'F') a full join (select c_custkey as k from customer where c_mktsegment = 'MACHINERY') b on a.k = b.k")
def entity_union(t: Tables) -> DataFrame:
    return E.entity_union((t.orders.where("o_orderstatus = 'F'"), "o_custkey"), (t.customer.where("c_mktsegment = 'MACHINERY'"), "c_custkey"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def known_minus_done(t: Tables) -> DataFrame:
    return E.pending(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])


@query("select user_id, case when count(distinct event_type) filter (where event_type <> 'error') = 0 then '' else array_to_string(list_sort(list(distinct event_type) filter (where event_type <> 'error')), ',') end as kinds from events group by user_id")
def list_minus_alias(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(L.without(F.collect_set("event_type"), "error"), ",").alias("kinds"))


@query("select doc_id as id, text, lang, 'corpus' as origin from documents union all select item_id, text, null, 'gold' from benchmark")
def concat_sources(t: Tables) -> DataFrame:
    return L.concat_sources({"corpus": t.documents.select(F.col("doc_id").alias("id"), "text", "lang"), "gold": t.benchmark.select(F.col("item_id").alias("id"), "text")})


@query("""with asked as (select distinct p_brand, p_size, p_brand || '-x' as other from part), a as (select case when p_size % 2 = 0 then p_brand else other end as p_brand, p_size from asked),
  e as (select p_brand, p_size, arg_min(p_name, p_partkey) as n from part group by all), f as (select p_size, arg_min(p_name, p_partkey) as n from part group by all)
  select a.p_brand, a.p_size, coalesce(e.n, f.n) as p_name, e.n is not null as exact from a left join e on e.p_brand = a.p_brand and e.p_size = a.p_size left join f on f.p_size = a.p_size""")
def bill_lookup(t: Tables) -> DataFrame:
    a = t.part.select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("-x"))).alias("p_brand"), "p_size").distinct()
    return I.bill_lookup(a, t.part, "p_brand", "p_size", "p_partkey", "p_name")


@query("""with people as (select lower(trim(p_name)) as k, p_partkey as person, p_size::varchar as born from part), c as (select k, count(*) as n, min(person) as only_one from people group by k),
  asked as (select distinct p_name, p_size % 10 as year from part)
  select a.p_name, a.year, case when c.n = 1 then only_one else (select min(person) from people p where p.k = lower(a.p_name) and contains(p.born, a.year::varchar)) end as person from asked a left join c on c.k = lower(a.p_name)""")
def resolve_identity(t: Tables) -> DataFrame:
    people = t.part.select("p_name", F.col("p_partkey").alias("person"), F.col("p_size").alias("born"))
    asked = t.part.select(F.upper("p_name").alias("up"), "p_name", (F.col("p_size") % 10).alias("year")).distinct().select("p_name", "year")
    return I.identity(asked, people, "p_name", "year", "born", "person")


MACRO_SQL = """macro as (select strftime(o_orderdate, '%Y-%m') as month, round(avg(o_totalprice), 2) as mean from orders where month(o_orderdate) % 4 <> 0 group by 1)"""


def articles_sql(asked: str, articles: str) -> str:
    """The best five articles of each `query` of a table, over a table of article and text."""
    return rf"""ix as (select distinct article, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{3,}}')) as word from {articles} where text is not null),
  spread as (select word, count(*) as n from ix group by word), tot as (select count(distinct article) as total from ix),
  terms as (select query, word, n, ln(total / n) as idf, row_number() over (partition by query order by n, word) as o from (select distinct query, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]{{3,}}')) as word from {asked}) join spread using (word) cross join tot),
  cand as (select distinct query, article from terms join ix using (word) where o <= 2),
  scored as (select query, article, round(sum(idf), 6) as weight from cand join terms using (query) join ix using (article, word) group by all),
  best as (select query, string_agg(article::varchar, ',' order by r) as articles from (select *, row_number() over (partition by query order by weight desc, article) as r from scored) where r <= 5 group by query)"""


def macro(t: Tables) -> DataFrame:
    months = t.orders.where(F.month("o_orderdate") % 4 != 0).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return months.agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query(rf"""with {MACRO_SQL}, l as (select conv_id, turn, case when conv_id % 3 > 0 then conv_id end as person, 'CUSTOMER#' || lpad((conv_id + 7)::varchar, 9, '0') as name, role || ' ' || substr(text, 1, 80) as query,
    strftime((select min(o_orderdate)::date from orders) + (conv_id * 3)::int, '%Y-%m-%d') as d from conversations),
  a as (select doc_id as article, text from documents), {articles_sql("l", "a")}
  select conv_id, turn, coalesce(p.c_mktsegment, f.c_mktsegment) as segment, coalesce(m.mean, b.mean) as mean, best.articles from l left join (select * from customer where c_custkey % 4 > 0) p on p.c_custkey = l.person
    left join (select * from customer where c_custkey % 4 > 0) f on p.c_custkey is null and upper(f.c_name) = l.name left join macro m on m.month = substr(d, 1, 7) left join macro b on m.month is null and b.month = strftime((substr(d, 1, 7) || '-01')::date - interval 1 month, '%Y-%m')
    left join best using (query)""")
def enrich_left(t: Tables) -> DataFrame:
    """Messages with the profile of a person or else a name, the economy of their month or the one before, and articles on their topic."""
    first = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("first"))  # one row
    lead = t.conversations.crossJoin(F.broadcast(first)).select(
        "conv_id", "turn", F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")).alias("person"), F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("conv_id") + 7).cast("string"), 9, "0")).alias("name"),
        F.concat("role", F.lit(" "), F.substring("text", 1, 80)).alias("query"), F.date_add("first", (F.col("conv_id") * 3).cast("int")).alias("d"),
    )
    profiles = t.customer.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    known = R.with_month(R.with_profile(lead, profiles, "person", "name", ["segment"]), macro(t), "d", "month", ["mean"], within=1)
    out = R.with_articles(known, t.documents, "query", "doc_id", "text")
    return out.select("conv_id", "turn", "segment", "mean", F.array_join("articles", ",").alias("articles"))
