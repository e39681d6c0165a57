"""Gates, checks, upserts, files and ordered scans bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import enrichment as M
from ..operators import gates as G
from ..operators import incremental as N
from ..operators import rows as R
from ..operators import sequential as Q
from ..operators import votes as V
from ..sources import files
from .registry import Tables, query
from .stats import MACRO_SQL, articles_sql, macro


@query("""with s as (select l_orderkey + case when l_partkey % 23 = 0 then 10000000 else 0 end as ballot, l_orderkey % 250 as chapter, l_suppkey, l_partkey, case l_returnflag when 'A' then 'the' when 'N' then 'des' else 'tion' end as quote, l_linenumber % 4 as n from lineitem),
    ch as (select doc_id as chapter, coalesce(text, '') as text from documents), ty as (select l_orderkey as ballot, count(*) as data_n from lineitem group by 1)
  select s.ballot, s.chapter, l_suppkey, l_partkey, case when ch.text is null then 'chapter missing' when not contains(ch.text, quote) then 'quote not in text' when o_orderkey is null then 'ballot missing'
    when a.k is not null then 'ballot annulled' when n is distinct from data_n then 'tally differs' end as reason
  from s left join ch using (chapter) left join orders on o_orderkey = s.ballot left join (select distinct l_orderkey as k from lineitem where l_tax = 0.08) a on a.k = s.ballot left join ty on ty.ballot = s.ballot""")
def gate_commitment(t: Tables) -> DataFrame:
    s = t.lineitem.select(
        (F.col("l_orderkey") + F.when(F.col("l_partkey") % 23 == 0, 10000000).otherwise(0)).alias("ballot"), (F.col("l_orderkey") % 250).alias("chapter"), "l_suppkey", "l_partkey",
        F.when(F.col("l_returnflag") == "A", "the").when(F.col("l_returnflag") == "N", "des").otherwise("tion").alias("quote"), (F.col("l_linenumber") % 4).cast("bigint").alias("n"),
    )
    chapters = t.documents.select(F.col("doc_id").alias("chapter"), F.coalesce("text", F.lit("")).alias("text"))
    tallies = t.lineitem.groupBy(F.col("l_orderkey").alias("ballot")).agg(F.count(F.lit(1)).alias("data_n"))
    annulled = t.lineitem.where("l_tax = 0.08").select(F.col("l_orderkey").alias("ballot"))
    out = G.gate_commitment(s, chapters, t.orders.select(F.col("o_orderkey").alias("ballot")), annulled, tallies, ["ballot"], ["n"])
    return out.select("ballot", "chapter", "l_suppkey", "l_partkey", "reason")


REF_SQL = r"""r as (select event_id, user_id as number, (event_id % 9)::integer as session, 'Ballot no. ' || user_id || ' of session ' || (event_id % 7) as ref, 'p' || event_id as snippet from events where event_type = 'click'),
  p as (select *, regexp_extract(ref, 'no\. (\d+)', 1)::bigint as rn, regexp_extract(ref, 'session (\d+)', 1)::integer as rs from r)"""


def _refs(t: Tables) -> DataFrame:
    r = t.events.where("event_type = 'click'").select("event_id", F.col("user_id").alias("number"), (F.col("event_id") % 9).cast("int").alias("session"))
    ref = F.concat(F.lit("Ballot no. "), F.col("number").cast("string"), F.lit(" of session "), (F.col("event_id") % 7).cast("string"))
    return r.withColumn("rn", F.regexp_extract(ref, r"no\. (\d+)", 1).try_cast("bigint")).withColumn("rs", F.regexp_extract(ref, r"session (\d+)", 1).try_cast("int"))


@query(f"with {REF_SQL} select event_id, nullif(concat_ws('; ', case when rn <> number then 'number differs' end, case when rs <> session then 'session differs' end), '') as reasons from p")
def ballot_ref_check(t: Tables) -> DataFrame:
    reasons = F.concat_ws("; ", F.when(F.col("rn") != F.col("number"), "number differs"), F.when(F.col("rs") != F.col("session"), "session differs"))
    return _refs(t).select("event_id", F.when(reasons != "", reasons).alias("reasons"))


@query(f"with {REF_SQL} select count(*) as total, count(*) filter (where rs <> session) as failures from p")
def gate_annotation(t: Tables) -> DataFrame:
    return _refs(t).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rs") != F.col("session")).alias("failures"))


RULES_SQL = """concat_ws(';', case when value is null or value < 0 or value > 100 then 'score out of range' end, case when user_id % 13 = 0 then 'no person' end,
  case when event_type not in ('click', 'view', 'purchase') then 'unknown kind' end, case when event_type = 'purchase' and value < 80 then 'tier differs' end)"""


def _tests() -> dict:
    v = F.col("value")
    return {
        "score out of range": v.isNull() | (v < 0) | (v > 100),
        "no person": F.col("user_id") % 13 == 0,
        "unknown kind": ~F.col("event_type").isin("click", "view", "purchase"),
        "tier differs": (F.col("event_type") == "purchase") & (v < 80),
    }


@query(f"select event_id, {RULES_SQL} as errors from events")
def schema_validate(t: Tables) -> DataFrame:
    return G.errors_of(t.events, _tests()).select("event_id", F.array_join("errors", ";").alias("errors"))


@query(f"""select event_type, count(*) as n, count(*) filter (where {RULES_SQL} <> '') as failing, count(*) filter (where props is null or props = '') as lost, count(*) filter (where value >= 95) as found,
  count(*) filter (where value >= 95) < 0.01 * count(*) as alarm, count(*) filter (where {RULES_SQL} <> '') > 0 or count(*) filter (where props is null or props = '') > 0 as failed from events group by 1""")
def corpus_regression(t: Tables) -> DataFrame:
    return G.corpus_regression(t.events, "event_type", _tests(), F.col("value") >= 95, F.coalesce(F.col("props") == "", F.lit(True)))


CHECKS_SQL = """sp as (select conv_id as day, turn as pos, turn // 2 as turn, 'u' || conv_id || '-' || (turn // 2) as url, 'a' || turn as anchor, turn % 5 <> 4 as ok, role as title, case when conv_id % 3 > 0 then conv_id::varchar else '' end as person, text,
    date '2024-01-01' + (conv_id % 28)::int as d, conv_id % 4 as session, turn * 60 - case when conv_id % 7 = 0 and turn = 3 then 200 when conv_id % 5 = 0 and turn = 2 then 80 else 0 end as sec from conversations),
  pg as (select conv_id as day, turn // 2 as turn, 'u' || conv_id || '-' || (turn // 2) as url, 'a' || turn as anchor, case when conv_id % 11 = 1 then 'other' else role end as label, case when conv_id % 3 = 1 then conv_id::varchar when conv_id % 3 = 2 then 'p' else '' end as person,
    case when (conv_id + turn) % 13 = 0 then 'Changed ' || text else text || ' ***' end as text from conversations where conv_id % 2 = 0 or turn < 6),
  one as (select url, anchor, min((label, person, text)) as x from pg group by all), f as (select sp.*, x[1] as label, x[2] as shown, x[3] as ptext from sp left join one using (url, anchor)),
  span as (select day, count(*) as n, min(turn) as a, max(turn) as b from sp group by day), seen as (select span.day, count(pg.day) as m, any_value(n) as n from span left join pg on pg.day = span.day and pg.turn between a and b group by span.day),
  od as (select *, last_value(sec ignore nulls) over (partition by day order by pos rows between unbounded preceding and 1 preceding) as before, lead(sec) over (partition by day order by pos) as following from sp),
  bl as (select o_orderkey as ballot, o_orderkey % 4 as session, case when o_orderkey % 9 > 0 then date '2024-01-01' + (o_orderkey % 28)::int end as d, (o_orderkey % 7) * 60 + 30 as sec from orders),
  mn as (select conv_id as day, turn as pos, conv_id + 100 * turn as ballot, case when conv_id % 2 = 0 then conv_id::varchar else '' end as person, case when conv_id % 5 > 0 then 'A' end as vote from conversations where turn % 2 = 1),
  nm as (select mn.day, mn.pos, mn.ballot, od.d as own, od.session as own_session, od.sec as start, od.following, bl.session, bl.d, bl.sec from mn join od using (day, pos) join bl using (ballot)),
  vt as (select l_orderkey as ballot, l_suppkey as person, min(l_returnflag) as value, case when min(l_suppkey) % 10 > 0 then 'c' || (l_suppkey % 5) end as club from lineitem group by l_orderkey, l_suppkey),
  tally as (select ballot, value, count(*) as n from vt group by all), decl as (select l_orderkey as ballot, min(l_returnflag) as value, count(distinct case when l_returnflag = x.least_flag then l_suppkey end) as declared from lineitem join (select l_orderkey as k, min(l_returnflag) as least_flag from lineitem group by 1) x on k = l_orderkey group by l_orderkey),
  diff as (select distinct ballot from tally full join decl using (ballot, value) where coalesce(n, 0) is distinct from declared),
  cl as (select s_suppkey as person, case when s_suppkey % 13 = 0 then 'x' else 'c' || (s_suppkey % 5) end as club, case when s_suppkey % 4 = 0 then date '2024-01-10' end as since from supplier),
  dt as (select vt.*, bl.d from vt join bl using (ballot) where club <> ''), mb as (select dt.*, (select min(club) from cl where cl.person = dt.person and dt.d is not null and (since is null or since <= dt.d)) as held from dt),
  vf as (select person::varchar as person, ballot::varchar as ballot, min(value) as fact from vt where person % 6 > 0 group by all),
  told as (select mn.*, fact from mn left join vf on vf.person = mn.person and vf.ballot = mn.ballot::varchar where mn.person <> '' and vote is not null),
  ms as (select substr(string_split(text, chr(10))[1], 1, 60) as head, case when doc_id % 10 = 0 then 'raw ' || substr(text, 2) else 'raw ' || text end as raw from documents)"""
_LINE_SQL = "select '{0}' as name, count(*) as total, count(*) filter (where {1}) as problems, count(*) filter (where {1}) = 0 as ok, {3} as blocking from {2}"
_CHECK_LINES = [
    ("anchor on a page", "not ok", "f", "true"), ("anchor of the same speaker", "label is distinct from title", "f where ok", "true"), ("person of the anchor", "person <> shown", "f where ok and label = title and shown <> ''", "true"),
    ("text of the page", "not (least(len(regexp_replace(t1, '[\\s*]+$', '')), len(regexp_replace(t2, '[\\s*]+$', '')), 200) > 0 and substr(t1, 1, least(len(regexp_replace(t1, '[\\s*]+$', '')), len(regexp_replace(t2, '[\\s*]+$', '')), 200)) = substr(t2, 1, least(len(regexp_replace(t1, '[\\s*]+$', '')), len(regexp_replace(t2, '[\\s*]+$', '')), 200)))",
     "(select trim(regexp_replace(text, '\\s+', ' ', 'g')) as t1, trim(regexp_replace(ptext, '\\s+', ' ', 'g')) as t2 from f where ok and label = title)", "true"),
    ("coverage of the day", "m <> n", "seen", "true"), ("times in order", "sec is null or before - sec > 60", "od", "true"),
    ("ballot of this sitting", "session <> own_session or coalesce(d not between own and own + 1, false)", "(select distinct ballot, day, session, own_session, d, own from nm)", "true"),
    ("ballot within the speech", "not (case when sec < start - 120 then sec + 86400 else sec end between start - 120 and coalesce(following, start + 3600) + 120)", "nm where start is not null and sec is not null", "false"),
    ("club of the register", "held is distinct from club", "mb", "true"), ("tally as declared", "b is not null", "(select o_orderkey, diff.ballot as b from orders left join diff on diff.ballot = o_orderkey)", "true"),
    ("fact of the vote", "fact is distinct from vote", "told", "true"), ("fact of the club", "held is distinct from club", "mb where d is not null", "true"),
    ("clean text of the speech", "not coalesce(head <> '' and contains(raw, head), false)", "ms", "true"),
]


@query(f"with {CHECKS_SQL} " + " union all ".join(_LINE_SQL.format(*x) for x in _CHECK_LINES))
def source_crosscheck(t: Tables) -> DataFrame:
    """The library's checks of sittings: messages as speeches, some of them otherwise on their page, and order lines as votes."""
    from ..operators.checks import source_crosscheck as crosscheck

    c, conv, turn = t.conversations, F.col("conv_id"), F.col("turn")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int"))
    place = [F.floor(turn / 2).alias("turn"), F.concat(F.lit("u"), conv.cast("string"), F.lit("-"), F.floor(turn / 2).cast("string")).alias("url"), F.concat(F.lit("a"), turn.cast("string")).alias("anchor")]
    own = F.when(conv % 3 > 0, conv.cast("string")).otherwise("")
    second = turn * 60 - F.when((conv % 7 == 0) & (turn == 3), 200).when((conv % 5 == 0) & (turn == 2), 80).otherwise(0)
    speeches = c.select(conv.alias("day"), turn.alias("pos"), *place, (turn % 5 != 4).alias("anchor_verified"), F.col("role").alias("title"), own.alias("person"), "text", day(conv).alias("date"), (conv % 4).alias("session"), second.alias("second"))
    label, person = F.when(conv % 11 == 1, "other").otherwise(F.col("role")), F.when(conv % 3 == 1, conv.cast("string")).when(conv % 3 == 2, "p").otherwise("")
    text = F.when((conv + turn) % 13 == 0, F.concat(F.lit("Changed "), F.col("text"))).otherwise(F.concat("text", F.lit(" ***")))
    page = c.where((conv % 2 == 0) | (turn < 6)).select(conv.alias("day"), *place, label.alias("label"), person.alias("person"), text.alias("text"))
    key = F.col("o_orderkey")
    ballots = t.orders.select(key.alias("ballot"), (key % 4).alias("session"), F.when(key % 9 > 0, day(key)).alias("date"), ((key % 7) * 60 + 30).alias("second"))
    mentions = c.where(turn % 2 == 1).select(conv.alias("day"), turn.alias("pos"), (conv + 100 * turn).alias("ballot"), F.when(conv % 2 == 0, conv.cast("string")).otherwise("").alias("person"), F.when(conv % 5 > 0, "A").alias("vote_of_speaker"))
    club = F.concat(F.lit("c"), (F.col("person") % 5).cast("string"))
    votes = t.lineitem.groupBy(F.col("l_orderkey").alias("ballot"), F.col("l_suppkey").alias("person")).agg(F.min("l_returnflag").alias("value")).withColumn("club", F.when(F.col("person") % 10 > 0, club))
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("ballot")).agg(F.min("l_returnflag").alias("value"))
    held = t.lineitem.select(F.col("l_orderkey").alias("ballot"), F.col("l_returnflag").alias("value"), "l_suppkey")
    declared = flags.join(held, ["ballot", "value"]).groupBy("ballot", "value").agg(F.count_distinct("l_suppkey").alias("declared"))
    s = t.supplier.select(F.col("s_suppkey").alias("person"))
    clubs = s.select("person", F.when(F.col("person") % 13 == 0, "x").otherwise(club).alias("club"), F.lit(1).alias("seq"), F.when(F.col("person") % 4 == 0, F.lit("2024-01-10").cast("date")).alias("since"), F.lit(None).cast("date").alias("until"))
    member = clubs.select(F.concat(F.lit("m"), F.col("person").cast("string")).alias("fact_id"), F.lit("CLUB_MEMBERSHIP").alias("predicate"), F.col("person").cast("string").alias("subject"), F.col("club").alias("object"), F.col("club").alias("literal"), F.col("since").alias("valid_from"), F.col("until").alias("valid_to"))
    cast = votes.where("person % 6 > 0").select(F.concat_ws("-", "person", "ballot").alias("fact_id"), F.lit("VOTE_CAST").alias("predicate"), F.col("person").cast("string").alias("subject"), F.col("ballot").cast("string").alias("object"), F.col("value").alias("literal"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    raw = F.concat(F.lit("raw "), F.when(F.col("doc_id") % 10 == 0, F.substr("text", F.lit(2))).otherwise(F.col("text")))
    messages = t.documents.select(F.col("text").alias("clean"), raw.alias("raw"))
    return crosscheck(speeches, page, mentions, ballots, votes, declared, clubs, member.unionByName(cast), messages)


@query("""with m as (select conv_id, turn, text, (conv_id * 8 + turn) % 15000 as ballot from conversations where role = 'assistant'),
    c as (select m.*, o_orderstatus, case when contains(lower(text), ' was ') then 'PRO' when contains(lower(text), ' from ') then 'PROTI' end as said, case o_orderstatus when 'F' then 'PRO' else 'PROTI' end as did, case o_orderstatus when 'P' then 'PROCEDURAL' else 'SUBSTANTIVE' end as kind from m join orders on o_orderkey = ballot)
  select conv_id, turn, ballot, kind, said, did, case when o_orderstatus = 'P' then 'procedural vote' when said is null then 'side missing' when said = did then 'agrees' else 'mismatch' end as reason from c""")
def vote_gold_cases(t: Tables) -> DataFrame:
    m = t.conversations.where("role = 'assistant'").withColumn("ballot", (F.col("conv_id") * 8 + F.col("turn")) % 15000)
    low, status = F.lower("text"), F.col("o_orderstatus")
    said = F.when(low.contains(" was "), V.PRO).when(low.contains(" from "), V.AGAINST)
    return V.vote_gold_cases(m.union(m), t.orders.withColumnRenamed("o_orderkey", "ballot"), ["conv_id", "turn"], "ballot", said, F.when(status == "F", V.PRO).otherwise(V.AGAINST), F.when(status == "P", "PROCEDURAL").otherwise("SUBSTANTIVE"))


@query("select e.kind as event_type, count(event_id) as n, count(event_id) < 2000 as problem from (select unnest(['click', 'view', 'error', 'refund']) as kind) e left join events on event_type = e.kind group by 1")
def coverage_check(t: Tables) -> DataFrame:
    return G.coverage(t.events, "event_type", ["click", "view", "error", "refund"], 2000)


@query("""with u as (select o_orderkey, o_custkey, o_totalprice, 1 as batch from orders union all select o_orderkey, o_custkey + 1, o_totalprice * 2, 2 from orders where o_orderkey % 3 = 0)
  select o_orderkey, o_custkey, o_totalprice, batch from (select *, row_number() over (partition by o_orderkey order by batch desc) as k from u) where k = 1""")
def upsert_latest(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("batch"))
    new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).alias("batch"))
    return N.upsert_latest(old, new, "o_orderkey", "batch")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey + 1 else o_custkey end as o_custkey, case when o_orderkey % 2 = 0 then 'yes' when o_orderkey % 3 = 0 then 'new' end as approved from orders""")
def upsert_preserving(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "yes").alias("approved"))
    new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("new").alias("approved"))
    return N.upsert_preserving(old, new, "o_orderkey", ["approved"])


@query("select o_orderkey, case when c_custkey is not null then 'passed' else o_orderstatus end as o_orderstatus from orders left join (select distinct c_custkey * 10 as c_custkey from customer) on c_custkey = o_orderkey")
def apply_status(t: Tables) -> DataFrame:
    decisions = t.customer.select((F.col("c_custkey") * 10).alias("o_orderkey"), F.lit("passed").alias("o_orderstatus"))
    return N.apply_status(t.orders.select("o_orderkey", "o_orderstatus"), decisions, "o_orderkey", "o_orderstatus")[0]


@query("""with c as (select user_id, max(ts) as stored, max(event_id) as answer from events group by 1)
  select u.user_id, case when timestamp '2024-01-31 00:00:00' - stored <= interval 36 hour then answer end as answer, coalesce(timestamp '2024-01-31 00:00:00' - stored <= interval 36 hour, false) as hit
  from (select distinct user_id from events union select -1) u left join c using (user_id)""")
def ttl_cache_lookup(t: Tables) -> DataFrame:
    cache = t.events.groupBy("user_id").agg(F.max("ts").alias("stored"), F.max("event_id").alias("answer"))
    asked = t.events.select("user_id").distinct().union(t.nation.where("n_nationkey = 0").select(F.lit(-1).cast("bigint")))
    return N.ttl_lookup(asked, cache, "user_id", "stored", "answer", F.lit("2024-01-31 00:00:00").cast("timestamp"), 36 * 3600)


@query(rf"""with p as (select l_orderkey as a, l_orderkey + 1 as b, l_partkey, l_suppkey, l_discount * 10 as contradiction, 1 - l_tax as similarity from lineitem where l_discount * 10 >= 0.5 and l_discount * 10 < 0.8 and 1 - l_tax >= 0.95),
  l as (select a, b, l_partkey, l_suppkey, x.o_custkey as person, y.o_custkey as b_message, c_name, p_name as query, strftime(x.o_orderdate, '%Y-%m') as month from p join orders x on x.o_orderkey = a join orders y on y.o_orderkey = b
    left join customer on c_custkey = x.o_custkey and c_custkey % 2 = 0 left join part on p_partkey = l_partkey where x.o_custkey <> y.o_custkey),
  ar as (select p_partkey as article, p_name || ' ' || p_brand as text from part), {MACRO_SQL}, {articles_sql("l", "ar")}
  select a, b, l_partkey, l_suppkey, person, b_message, c_name, mean, articles from l left join macro using (month) left join best using (query)""")
def lead_queue(t: Tables) -> DataFrame:
    """Leads with the profile of the speaker, the economy of the month of the newer claim and articles on its topic."""
    pairs = t.lineitem.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("contradiction"), (1 - F.col("l_tax")).alias("similarity"))
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("message_id"), F.col("o_orderpriority").alias("text"), F.col("o_custkey").alias("person"))
    profiles = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("person"), "c_name")
    leads = N.lead_queue(pairs, claims, profiles, 0.5, 0.8, 0.95).join(t.orders.select(F.col("o_orderkey").alias("a"), "o_orderdate"), "a")
    leads = leads.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("query")), "l_partkey", "left")
    leads = M.with_month(leads.select("a", "b", "l_partkey", "l_suppkey", "person", "b_message", "c_name", "query", "o_orderdate"), macro(t), "o_orderdate", "month", ["mean"])
    out = M.with_articles(leads, t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text")), "query", "p_partkey", "text")
    return out.select("a", "b", "l_partkey", "l_suppkey", "person", "b_message", "c_name", "mean", F.array_join("articles", ",").alias("articles"))


@query("""with r as (select distinct sha256('role::v1::' || text) as cache_key from documents where text is not null), c as (select distinct sha256('role::v1::' || text) as cache_key from documents where doc_id % 3 = 0),
  a as (select distinct sha256('role::v1::' || text) as cache_key from documents where doc_id % 5 = 0)
  select r.cache_key, case when c.cache_key is not null then 'cached' when a.cache_key is not null then 'answered' else 'pending' end as state from r left join c using (cache_key) left join a using (cache_key)""")
def model_call_plan(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").select("doc_id", X.stable_key(F.lit("role"), F.lit("v1"), F.col("text")).alias("cache_key"))
    return N.call_plan(d.select("cache_key"), d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 0"), "cache_key").select("cache_key", "state")


@query("select n_nationkey, n_name, n_regionkey from nation")
def read_unl(t: Tables) -> DataFrame:
    path = files.shared_path(t.spark, "unl")
    files.write_unl(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return files.read_unl(t.spark, path, schema).drop("seq")


@query("select l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def parse_vote_dumps(t: Tables) -> DataFrame:
    parents = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return files.child_rows(t.lineitem, parents, "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("select lower(n_name) as domain, n_regionkey::integer as tier, 'note ' || n_nationkey as note from nation where n_regionkey > 0")
def read_lookup_csv(t: Tables) -> DataFrame:
    path = files.shared_path(t.spark, "lookup")
    tier = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).otherwise("none")
    t.nation.select(F.upper("n_name").alias("domain"), tier.alias("tier"), F.concat(F.lit("note "), F.col("n_nationkey").cast("string")).alias("note")).write.option("header", True).csv(path)
    return files.read_lookup(t.spark, path)


@query("""select 'clubs' as kind, s_suppkey as organ_id, null::bigint as person_id, s_name as abbr from supplier where s_nationkey % 6 = 1
  union all select 'club membership', s_suppkey, l_orderkey, s_name from lineitem join supplier on l_suppkey = s_suppkey where l_linenumber % 2 = 0 and s_nationkey % 6 = 1
  union all select 'government membership', s_suppkey, l_orderkey, null from lineitem join supplier on l_suppkey = s_suppkey where l_linenumber % 2 = 0 and s_nationkey % 6 = 5
  union all select 'deputy', null, c_custkey, null from customer where c_nationkey = 7""")
def load_registry(t: Tables) -> DataFrame:
    organs = t.supplier.select(F.col("s_suppkey").alias("organ_id"), (F.col("s_nationkey") % 6).alias("type"), F.col("s_name").alias("abbr"))
    memberships = t.lineitem.select(F.col("l_orderkey").alias("person_id"), F.col("l_suppkey").alias("organ_id"), (F.col("l_linenumber") % 2).alias("function"))
    people = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("term"))
    found = files.registry(people, organs, memberships, people, 7)
    none = F.lit(None)
    rows = lambda kind, df, organ, person, abbr: df.select(F.lit(kind).alias("kind"), organ.cast("bigint").alias("organ_id"), person.cast("bigint").alias("person_id"), abbr.cast("string").alias("abbr"))
    organ, person, abbr = F.col("organ_id"), F.col("person_id"), F.col("abbr")
    out = rows("clubs", found["clubs"], organ, none, abbr).unionByName(rows("club membership", found["club_memberships"], organ, person, abbr))
    return out.unionByName(rows("government membership", found["government_memberships"], organ, person, none)).unionByName(rows("deputy", found["deputies"], none, person, none))


@query("select event_id, event_type, case when event_type = 'click' then value * 2 else value end as value from events where event_type is not null")
def replace_partition(t: Tables) -> DataFrame:
    path = files.shared_path(t.spark, "partitions")
    e = t.events.where("event_type is not null").select("event_id", "event_type", "value")
    e.write.partitionBy("event_type").parquet(path)
    new = e.where("event_type = 'click'").withColumn("value", F.col("value") * 2)
    for _ in range(2):  # a repeated call changes nothing
        N.replace_partition(new, path, "event_type")
    return t.spark.read.parquet(path).select("event_id", "event_type", "value")


@query("select conv_id, turn, role, text from conversations")
def read_nested_corpus(t: Tables) -> DataFrame:
    path = files.shared_path(t.spark, "nested")
    nested = files.nested_dataset(t.conversations, "conv_id", "turn", ["turn", "role", "text"])
    nested.write.json(path)
    message = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("messages", T.ArrayType(message))])
    return files.read_nested(t.spark, path, schema, lines=True).select("conv_id", "turn", "role", "text")


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as month, o_orderdate, o_orderkey, o_totalprice from orders), d as (select o_orderdate::date as d, o_orderpriority as name, floor(max(o_totalprice)) as v from orders group by all)
  select 'mean' as kind, '' as name, strftime(ts, '%Y-%m') as month, round(avg(value), 3) as value from events group by month union all select 'last', '', strftime(ts, '%Y-%m') as month, arg_max(value, (ts, event_id)) from events where value is not null group by month
  union all select 'rate', '', month, round(arg_max(o_totalprice, o_orderkey), 2) from m where o_orderkey % 5 <> 4 group by month
  union all select 'table', name, strftime(d, '%Y-%m'), round(avg(v), 3) from d group by all""")
def flatten_series(t: Tables) -> DataFrame:
    """Three kinds of sources: rows, records whose keys change, and a piped table with a column a priority."""
    o = t.orders
    rows = files.monthly(t.events.select(F.struct("ts", "event_id").alias("at"), "ts", "value"), "ts", "value", order="at")
    plain = rows.select("month", F.inline(F.array(F.struct(F.lit("mean").alias("kind"), F.col("mean").alias("value")), F.struct(F.lit("last").alias("kind"), F.col("last").alias("value"))))).withColumn("name", F.lit(""))
    # a record names its day and its rate in one of five ways, and one in five has no usable rate
    way, day = F.col("o_orderkey") % 5, F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    number, comma = F.col("o_totalprice"), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    record = (
        F.when(way == 0, F.to_json(F.struct(day.alias("date"), number.alias("2T repo")))).when(way == 1, F.to_json(F.struct(day.alias("datum"), F.lit("").alias("date"), comma.alias("repo"))))
        .when(way == 2, F.to_json(F.struct(day.alias("date"), F.lit(0).alias("repo"), number.alias("Repo")))).when(way == 3, F.to_json(F.struct(day.alias("datum"), number.alias("rate"), F.lit("x").alias("other"))))
        .when(F.col("o_orderkey") % 3 == 0, "not json").otherwise(F.to_json(F.struct(day.alias("date"), F.lit(0).alias("rate"))))
    )
    rates = files.rate_series(o.select(F.col("o_orderkey").alias("seq"), record.alias("record")), "record", "seq").select(F.lit("rate").alias("kind"), F.lit("").alias("name"), "month", "value")
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    by_day = o.groupBy(F.to_date("o_orderdate").alias("d")).pivot("o_orderpriority", kinds).agg(F.format_string("%.1f", F.floor(F.max("o_totalprice")).cast("double")))
    cells = [F.coalesce(F.replace(F.col(f"`{k}`"), F.lit("."), F.lit(",")), F.lit("")) for k in kinds]
    lines = by_day.select(F.unix_date("d").alias("seq"), F.concat_ws("|", F.date_format("d", "dd.MM.yyyy"), *cells).alias("line"))
    head = t.region.limit(1).select(F.lit(-1).alias("seq"), F.lit("|".join(["day", *kinds])).alias("line"))
    table = files.piped_series(head.union(lines), "line", "seq").select(F.lit("table").alias("kind"), "name", "month", "value")
    return plain.select("kind", "name", "month", "value").union(rates).union(table)


@query("select sha256('role::v1::' || text) as cache_key, min('answer ' || doc_id) as response_text from documents where text is not null and doc_id % 4 = 0 group by 1")
def model_responses(t: Tables) -> DataFrame:
    path = files.shared_path(t.spark, "responses")
    d = t.documents.where("text is not null and doc_id % 4 = 0").groupBy(X.stable_key(F.lit("role"), F.lit("v1"), F.col("text")).alias("cache_key")).agg(F.min(F.concat(F.lit("answer "), F.col("doc_id").cast("string"))).alias("a"))
    d.select("cache_key", F.concat(F.lit("```text\n"), F.col("a"), F.lit("\n```")).alias("response_text")).write.json(path)
    return files.read_responses(t.spark, path)


@query()
def resolve_ambiguous_clock(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", F.to_date("ts").alias("d"), F.date_format("ts", "Hmm").alias("digits"))
    return Q.ambiguous_clocks(e, ["user_id", "d"], "event_id", "digits")


@query()
def greedy_anchor_match(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.to_date("ts").alias("d"), F.col("event_id").alias("pos"), F.col("event_type").alias("label"))
    right = e.where("pos % 4 <> 0").withColumn("anchor", F.col("pos"))
    return Q.greedy_anchor_match(e, right, ["user_id", "d"], "pos", "label", "anchor")


PLAIN_SQL = """lambda x: trim(lower(x), '.,!?;:"' || chr(39))"""


@query(rf"""with w as (select conv_id * 1000 + turn as id, regexp_split_to_array(text, '[ \n\t]+') as raw from conversations where text is not null),
  qs as (select id, list_transform(raw, {PLAIN_SQL}) as ws, list_transform(list_filter(raw[len(raw) // 3 + 1:len(raw) // 3 + 6], lambda x: x <> ''), {PLAIN_SQL}) as q from w),
  runs as (select id, a, n, ws[a:a + n - 1] = q[b:b + n - 1] as same from (select id, ws, q, unnest(range(1, len(ws) + 1)) as a from qs) cross join (select unnest(range(1, 7)) as b) cross join (select unnest(range(1, 7)) as n)
    where b + n - 1 <= len(q) and a + n - 1 <= len(ws)),
  best as (select id, max(n) as n, arg_min(a, (-n, a)) as a from runs where same group by id)
  select qs.id as conv_id, case when n is not null then (a - 1) * 0.5 end::double as begin, case when n is not null then (a + n - 2) * 0.5 + 0.4 end::double as finish, coalesce(n, 0)::integer as n_words from qs left join best using (id)""")
def longest_common_block(t: Tables) -> DataFrame:
    """The words of each message against a quote from the middle of it."""
    c = t.conversations.where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), F.split("text", r"[ \n\t]+").alias("parts"))
    words = c.select("conv_id", F.posexplode("parts").alias("pos", "word")).withColumn("a", F.col("pos") * 0.5).withColumn("b", F.col("pos") * 0.5 + 0.4)
    quotes = c.select("conv_id", F.array_join(F.slice("parts", F.floor(F.size("parts") / 3).cast("int") + 1, F.lit(6)), " ").alias("quote"))
    return Q.longest_common_block(words, quotes, "conv_id", "pos", "word", "a", "b", "quote")


@query()
def article_date(t: Tables) -> DataFrame:
    return R.article_date(t.pages, "html", F.lit("2025-01-01").cast("date")).select("page_id", "date", "reason")


@query()
def chapters_from_html(t: Tables) -> DataFrame:
    return R.chapters(t.pages, "page_id", "html", level="h1")
