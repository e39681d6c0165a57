"""Temporal joins and checks bound to events, conversations, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import temporal as T
from .registry import Tables, query

IV_SQL = """iv as (select user_id, event_id as seq, event_type || '/' || (event_id % 7) as label, ts::date as since,
  lead(ts::date) over (partition by user_id order by ts, event_id) as until from events where event_type in ('signup', 'purchase'))"""
EXCUSE_SQL = """excuse as (select user_id, ts::date as d, hour(ts) * 60 + minute(ts) - 120 as f, hour(ts) * 60 + minute(ts) + 120 as t from events where event_type = 'error')"""


def intervals(t: Tables) -> DataFrame:
    """Intervals of a user from each signup or purchase to the next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.concat_ws("/", "event_type", (F.col("event_id") % 7).cast("string"))
    e = t.events.where(F.col("event_type").isin("signup", "purchase"))
    return e.select("user_id", F.col("event_id").alias("seq"), label.alias("label"), F.to_date("ts").alias("since"), F.lead(F.to_date("ts")).over(w).alias("until"))


def minute(ts: str = "ts"):
    return F.hour(ts) * 60 + F.minute(ts)


def excuses(t: Tables) -> DataFrame:
    """Windows of two hours around each error event."""
    return t.events.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("d"), (minute() - 120).alias("f"), (minute() + 120).alias("t"))


@query(f"""with {IV_SQL} select e.event_id, e.user_id, e.ts::date as d, (select arg_min(label, seq) from iv where iv.user_id = e.user_id
  and (since is null or e.ts::date >= since) and (until is null or e.ts::date <= until)) as label from events e where event_type = 'click'""")
def interval_at(t: Tables) -> DataFrame:
    probes = t.events.where("event_type = 'click'").select("event_id", "user_id", F.to_date("ts").alias("d"))
    return T.interval_at(probes, intervals(t), "user_id", "d", "label", "seq")


@query(f"""with {IV_SQL} select e.event_id, e.user_id, e.ts::date as d, (select arg_max(label, struct_pack(a := since, b := seq)) from iv where iv.user_id = e.user_id
  and (since is null or e.ts::date >= since) and (until is null or e.ts::date <= until)) as label from events e where event_type = 'click'""")
def fact_at(t: Tables) -> DataFrame:
    probes = t.events.where("event_type = 'click'").select("event_id", "user_id", F.to_date("ts").alias("d"))
    return T.fact_at(probes, intervals(t), "user_id", "d", "label", "since", "until", "seq")


@query("""select o_orderkey, l_partkey, l_quantity from orders left join (select l_orderkey, 3 as l_linenumber, arg_min(l_quantity, l_partkey * 1000000 + l_suppkey) as l_quantity,
  min(l_partkey) as l_partkey from lineitem where l_linenumber = 3 group by l_orderkey) on o_orderkey = l_orderkey""")
def fact_for_object(t: Tables) -> DataFrame:
    facts = t.lineitem.withColumn("seq", F.col("l_partkey") * 1000000 + F.col("l_suppkey"))
    probes = t.orders.select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), F.lit(3).alias("l_linenumber"))
    first = T.fact_for_object(probes, facts, ["l_orderkey", "l_linenumber"], "l_quantity", "seq")
    return T.fact_for_object(first, facts, ["l_orderkey", "l_linenumber"], "l_partkey", "l_partkey").select("o_orderkey", "l_partkey", "l_quantity")


@query(f"""with {EXCUSE_SQL} select event_id, user_id, exists(select 1 from excuse x where x.user_id = e.user_id and x.d = e.ts::date
  and hour(e.ts) * 60 + minute(e.ts) between x.f and x.t) as excused from events e where event_type in ('purchase', 'signup')""")
def excused_at(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_type").isin("purchase", "signup")).select("event_id", "user_id", F.to_date("ts").alias("d"), minute().alias("m"))
    return T.excused(e, excuses(t), ["user_id", "d"], "m", "f", "t").select("event_id", "user_id", "excused")


@query("""with m as (select event_id, user_id, floor(epoch(ts) / 60)::bigint as m, props from events)
  select a.user_id, a.event_id, b.event_id as other, abs(a.m - b.m) as gap, substr(b.props, 1, 500) as other_text from m a join m b on a.user_id = b.user_id
  and abs(a.m - b.m) <= 60 and a.event_id <> b.event_id""")
def same_context_window(t: Tables) -> DataFrame:
    m = t.events.select("event_id", "user_id", F.floor(F.unix_timestamp("ts") / 60).alias("m"), "props")
    return T.context_window(m, "user_id", "event_id", "m", "props")


@query("""with s as (select user_id, event_id, ts as a, lead(ts) over (partition by user_id order by ts, event_id) as b from events where event_type = 'signup')
  select e.event_id, e.user_id, (select arg_min(s.event_id, s.a) from s where s.user_id = e.user_id and e.ts >= s.a and e.ts < s.b) as turn from events e where event_type = 'view'""")
def point_in_turn(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    turns = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("turn"), F.col("ts").alias("a"), F.lead("ts").over(w).alias("b"))
    points = t.events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return T.point_in_turn(points, turns, "user_id", "ts", "a", "b", "turn").drop("ts")


@query("""with p as (select event_id, user_id, ts from events where event_type = 'click'), s as (select user_id, event_id as segment, ts from events where event_type = 'signup')
  select p.event_id, p.user_id, s.segment from p asof left join s on p.user_id = s.user_id and p.ts >= s.ts""")
def segment_for_moment(t: Tables) -> DataFrame:
    p = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    s = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("segment"), F.col("ts").alias("at"))
    return T.latest_before(p, s, "user_id", "ts", "at", "segment").drop("ts")


@query("""with days as (select distinct o_orderdate::date as d from orders), r as (select o_orderdate::date as d, max(o_orderkey) as recording, min(o_totalprice) as start
  from orders where o_orderpriority = '1-URGENT' group by 1) select days.d, r.recording, r.start, r.d is null as unmatched from days left join r using (d)""")
def day_recording_join(t: Tables) -> DataFrame:
    days = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    r = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.max("o_orderkey").alias("recording"), F.min("o_totalprice").alias("start"))
    found, missing = T.recordings(days, r, "d", ["recording", "start"])
    return found.where("recording is not null").withColumn("unmatched", F.lit(False)).unionByName(missing.withColumn("unmatched", F.lit(True)), allowMissingColumns=True)


@query("""with s as (select ts::date as d, round(sum(value), 2) as v from events group by 1) select a.d, a.v, b.v as past, round(a.v - b.v, 2) as diff,
  case when round(a.v - b.v, 2) > 0 then 'up' when round(a.v - b.v, 2) < 0 then 'down' else 'same' end as direction from s a join s b on b.d + 7 = a.d""")
def year_ago_join(t: Tables) -> DataFrame:
    s = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.round(F.sum("value"), 2).alias("v"))
    return T.year_ago(s, "d", "v", F.date_add("d", 7))


@query("""select event_id, user_id, lag(ts) over w as prev_at, coalesce(lead(ts) over w, ts + interval 1 hour) as next_at from events window w as (partition by user_id order by ts, event_id)""")
def next_prev_time(t: Tables) -> DataFrame:
    return T.neighbours(t.events.select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "ts").drop("ts")


@query("""with s as (select event_id, user_id, case when event_id % 11 = 0 then null else hour(ts) * 3600 + minute(ts) * 60 + second(ts) end as s from events),
  l as (select *, last_value(s ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as p from s)
  select event_id, user_id, case when s is null then 'missing' when p - s > 60 then 'problem' when p - s > 0 then 'rounding' else 'ok' end as verdict from l""")
def order_check(t: Tables) -> DataFrame:
    second = F.when(F.col("event_id") % 11 != 0, F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
    return T.order_check(t.events.select("event_id", "user_id", second.alias("s")), "user_id", ["event_id"], "s").drop("s")


@query("""with s as (select event_id, user_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as s from events),
  l as (select *, lag(s) over w as a, lead(s) over w as b from s window w as (partition by user_id order by event_id))
  select event_id, user_id, case when s < a - 120 then s + 86400 else s end between a - 120 and coalesce(b, a + 3600) + 120 as in_window from l where a is not null""")
def within_window_check(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.select("event_id", "user_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("s"))
    e = e.withColumn("a", F.lag("s").over(w)).withColumn("b", F.lead("s").over(w)).where("a is not null")
    return T.within_window(e, "s", "a", "b").select("event_id", "user_id", "in_window")


@query("""select event_id, user_id, coalesce(last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id
  rows between unbounded preceding and current row), -user_id) as marker from events""")
def carry_forward_marker(t: Tables) -> DataFrame:
    e = t.events.withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return T.carry_forward(e, "user_id", ["ts", "event_id"], "mark", -F.col("user_id"), "marker").select("event_id", "user_id", "marker")


@query("""select event_id, user_id, (select max(s.event_id) from events s where s.user_id = e.user_id and s.event_type = 'view' and s.event_id < e.event_id) as mention
  from events e where event_type = 'purchase'""")
def last_mention_before(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'purchase'").select("event_id", "user_id")
    m = t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("mention"))
    return T.latest_before(e, m, "user_id", "event_id", "at", "mention", inclusive=False)


@query(f"""with {IV_SQL}, p as (select e.event_id, e.user_id, e.event_type || '/' || (e.event_id % 7) as recorded, (select arg_min(label, seq) from iv where iv.user_id = e.user_id
  and (since is null or e.ts::date >= since) and (until is null or e.ts::date <= until)) as label from events e where event_type in ('signup', 'purchase'))
  select event_id, user_id, recorded, label, recorded is not distinct from label as agrees from p""")
def domain_crosscheck(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_type").isin("signup", "purchase"))
    p = e.select("event_id", "user_id", F.to_date("ts").alias("d"), F.concat_ws("/", "event_type", (F.col("event_id") % 7).cast("string")).alias("recorded"))
    found = T.interval_at(p, intervals(t), "user_id", "d", "label", "seq")
    return found.select("event_id", "user_id", "recorded", "label", F.col("recorded").eqNullSafe(F.col("label")).alias("agrees"))


@query("""with e as (select event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as clock, 21600 as start, event_id % 977 as chars,
  case when event_id % 5 = 0 then event_id end as exact from events), o as (select *, case when clock - start >= 0 then clock - start end as offset_s from e)
  select event_id, offset_s, case when offset_s is null then 'UNPAIRED' else 'OFFSET_SYNC' end as pairing, coalesce(exact, offset_s + round(chars / 14.5)::bigint) as second from o""")
def media_join(t: Tables) -> DataFrame:
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    e = t.events.select("event_id", clock.alias("clock"), F.lit(21600).alias("start"), (F.col("event_id") % 977).alias("chars"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("exact"))
    return T.media_offset(e, "clock", "start", "chars", "exact").select("event_id", F.col("offset_s").cast("bigint").alias("offset_s"), "pairing", "second")
