"""Votes bound to events and to orders (ballots), lineitem (votes) and suppliers (persons)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import temporal as T
from ..operators import votes as V
from .joins import EXCUSE_SQL, IV_SQL, excuses, intervals, minute
from .registry import Tables, query


@query(f"""with {EXCUSE_SQL}, v as (select e.*, exists(select 1 from excuse x where x.user_id = e.user_id and x.d = e.ts::date
    and hour(e.ts) * 60 + minute(e.ts) between x.f and x.t) as ex from events e)
  select user_id, count(*) as total, count(*) filter (where event_type = 'click') as pro, count(*) filter (where event_type = 'view') as against,
    count(*) filter (where event_type = 'error') as abstain, count(*) filter (where event_type in ('signup', 'purchase')) as absent,
    count(*) filter (where event_type in ('signup', 'purchase') and ex) as excused,
    round(count(*) filter (where event_type in ('click', 'view', 'error')) / count(*), 4) as attendance from v group by user_id""")
def voting_balance(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("d"), minute().alias("m"))
    absent = F.col("event_type").isin("signup", "purchase")
    flagged = T.excused(e.where(absent), excuses(t), ["user_id", "d"], "m", "f", "t")
    votes = flagged.unionByName(e.where(~absent).withColumn("excused", F.lit(False)))
    return V.balance(votes, "user_id", "event_type", "click", "view", "error", "excused")


def _tally_votes(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "n_name", "l_returnflag")


@query("""select l_orderkey, n_name, count(*) filter (where l_returnflag = 'A') as pro, count(*) filter (where l_returnflag = 'N') as against,
  count(*) filter (where l_returnflag = 'X') as other, count(*) filter (where l_returnflag in ('A', 'N', 'X')) as total
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all""")
def group_tally(t: Tables) -> DataFrame:
    return V.group_tally(_tally_votes(t), "l_orderkey", "n_name", "l_returnflag", {"pro": "A", "against": "N", "other": "X"})


@query("""with v as (select l_orderkey, n_name, count(*) filter (where l_returnflag = 'A') as pro, count(*) filter (where l_returnflag = 'N') as against,
    count(*) filter (where l_returnflag not in ('A', 'N')) as absent from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)
  select o_orderkey as l_orderkey, c.n_name, v.pro, v.against, v.absent from orders cross join (select unnest(['NATION_1', 'NATION_2']) as n_name) c
  left join v on v.l_orderkey = o_orderkey and v.n_name = c.n_name""")
def single_group_tally(t: Tables) -> DataFrame:
    ballots = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return V.single_group_tally(_tally_votes(t), ballots, "l_orderkey", "n_name", "l_returnflag", ["NATION_1", "NATION_2"], {"pro": "A", "against": "N", "absent": "-"}, "absent")


@query("""with last as (select l_orderkey, l_linenumber, arg_max(struct_pack(s := l_suppkey, p := l_partkey), struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_quantity,
    e := l_extendedprice, f := l_discount, g := l_tax)) as r from lineitem group by 1, 2)
  select distinct l.l_orderkey, l.l_linenumber, l.l_suppkey, p_partkey, p_name from lineitem l join last using (l_orderkey, l_linenumber) left join part on p_partkey = r.p where l.l_suppkey = r.s""")
def record_to_item(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    probes = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    found = V.record_to_item(probes, t.lineitem, ["l_orderkey", "l_linenumber"], "l_suppkey", order, ["l_partkey"])
    return found.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_partkey", "p_name"), "l_partkey", "left").drop("l_partkey")


@query("select l_orderkey, l_linenumber, l_suppkey, o_custkey, o_orderdate::date as d from lineitem join orders on l_orderkey = o_orderkey")
def turn_lookup(t: Tables) -> DataFrame:
    from ..operators.selections import turn_lookup as lookup

    turns = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("d"))
    return lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), turns, "l_orderkey", ["o_custkey", "d"])


@query("""select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_partkey % 10 = 3)
  and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def votes_for_item(t: Tables) -> DataFrame:
    line = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    found = V.votes_for_item(t.orders, line.where("l_partkey % 10 = 3"), ["o_orderkey"], line.where("l_returnflag = 'R'"), "o_orderkey")
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


FINAL_SQL = """claims as (select event_id, user_id as bill, (event_id % 4)::integer as session from events where event_type = 'click'),
  finals as (select o_custkey as bill, (o_orderkey % 4)::integer as session, o_orderkey as ballot from orders where o_orderstatus = 'F'),
  own as (select bill, session, min(ballot) as ballot from finals group by all), one as (select bill, min(ballot) as ballot from finals group by all),
  f as (select event_id, c.bill, c.session, coalesce(own.ballot, one.ballot) as ballot, case when own.ballot is not null then c.session else (one.ballot % 4)::integer end as final_session
    from claims c left join own on own.bill = c.bill and own.session = c.session left join one on one.bill = c.bill)"""


def _final_votes(t: Tables) -> DataFrame:
    claims = t.events.where("event_type = 'click'").select("event_id", F.col("user_id").alias("bill"), (F.col("event_id") % 4).cast("int").alias("session"))
    finals = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("bill"), (F.col("o_orderkey") % 4).cast("int").alias("session"), F.col("o_orderkey").alias("ballot"))
    return V.final_votes(claims, finals, "bill", "session", "ballot", ["ballot"])


@query(f"""with {FINAL_SQL} select event_id, bill, session, ballot from f where final_session = session and ballot not in (select l_orderkey from lineitem where l_tax = 0.08)
  and (event_id % 3 = 0 or ballot % 5 <> 0)""")
def final_vote_join(t: Tables) -> DataFrame:
    # every third claim's bill has a page without links, the others' pages name a ballot that is off by one for every fifth
    annulled = t.lineitem.where("l_tax = 0.08").select(F.col("l_orderkey").alias("ballot"))
    links = F.when(F.col("event_id") % 3 != 0, F.array(F.col("ballot") + F.when(F.col("ballot") % 5 == 0, 1).otherwise(0)))
    ballots = t.orders.select(F.col("o_orderkey").alias("ballot"))
    found = V.linked_finals(_final_votes(t).withColumn("links", links), ballots, annulled, "ballot", "links", ("session", "final_session"))
    return found.select("event_id", "bill", "session", "ballot")


CLAIM_SQL = f"""{FINAL_SQL}, votes as (select l_orderkey as ballot, l_suppkey as person, min(case l_returnflag when 'A' then 'PRO' when 'N' then 'PROTI' else 'JINAK' end) as vote from lineitem group by all),
  cv as (select event_id, f.bill, f.session, f.ballot, person, case event_id % 2 when 0 then 'PRO' else 'PROTI' end as stance, vote from f join votes using (ballot) where final_session = f.session)"""


def _claim_votes(t: Tables) -> DataFrame:
    votes = V.one_vote(t.lineitem, F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_returnflag"), "A", "N")
    stance = F.when(F.col("event_id") % 2 == 0, V.PRO).otherwise(V.AGAINST)
    return _final_votes(t).where("final_session = session").join(votes, "ballot").withColumn("stance", stance)


@query(f"""with {CLAIM_SQL} select event_id, bill, session, ballot, person, stance, vote, case when vote = 'JINAK' then 'NEHLASOVAL' when vote = stance then 'SHODA' else 'NESHODA' end as agreement from cv""")
def claim_vote_join(t: Tables) -> DataFrame:
    out = _claim_votes(t).withColumn("agreement", V.agreement(F.col("stance"), F.col("vote")))
    return out.select("event_id", "bill", "session", "ballot", "person", "stance", "vote", "agreement")


@query(f"""with {CLAIM_SQL} select substr(sha1(event_id || ':' || ballot || ':' || person), 1, 16) as id, event_id, ballot, person, vote,
  case when vote = 'JINAK' then 'NEHLASOVAL' when vote = stance then 'SHODA' else 'NESHODA' end as agreement from cv""")
def role_flip_record(t: Tables) -> DataFrame:
    key = F.substring(F.sha1(F.concat_ws(":", "event_id", "ballot", "person")), 1, 16)
    return _claim_votes(t).select(key.alias("id"), "event_id", "ballot", "person", "vote", V.agreement(F.col("stance"), F.col("vote")).alias("agreement"))


@query("""with c as (select conv_id, role, count(*) as n, min(turn) as first from conversations group by all)
  select conv_id, arg_max(role, struct_pack(a := n, b := -first)) as role, max(n) as n, sum(n)::bigint as messages, round(max(n) / sum(n), 3) as share from c group by conv_id""")
def debate_item_mode(t: Tables) -> DataFrame:
    return V.item_mode(t.conversations, "conv_id", "role", "turn")


LEDGER_SQL = """m as (select conv_id, turn, (conv_id * 8 + turn // 3) % 1000 as item, turn % 3 as person, role as name, coalesce(role = 'system', false) as chair from conversations),
  c as (select conv_id, item, count(*) as n, min(turn) as f from m group by all), i as (select conv_id, arg_max(item, struct_pack(a := n, b := -f)) as item from c group by conv_id),
  b as (select o_orderkey as ballot, o_orderkey % 1000 as item, case o_orderkey % 3 when 0 then 'Novela zákona jako celek' when 1 then 'Pořad schůze' else 'Pozměňovací návrh A' end as subject, case when o_orderstatus = 'F' then 'A' else 'R' end as result from orders),
  v as (select l_orderkey as ballot, l_suppkey % 3 as person, min(l_returnflag) as flag, max(l_linenumber) > 4 as excused from lineitem group by all)"""


def _ledger_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = t.conversations.select(
        "conv_id", "turn", ((F.col("conv_id") * 8 + F.floor(F.col("turn") / 3)) % 1000).alias("item"), (F.col("turn") % 3).alias("person"), F.col("role").alias("name"), (F.col("role") == "system").alias("chair")
    )
    k = F.col("o_orderkey")
    subject = F.when(k % 3 == 0, "Novela zákona jako celek").when(k % 3 == 1, "Pořad schůze").otherwise("Pozměňovací návrh A")
    b = t.orders.select(k.alias("ballot"), (k % 1000).alias("item"), subject.alias("subject"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("R").alias("result"))
    v = t.lineitem.groupBy(F.col("l_orderkey").alias("ballot"), (F.col("l_suppkey") % 3).alias("person")).agg(F.min("l_returnflag").alias("flag"), (F.max("l_linenumber") > 4).alias("excused"))
    return m, b, v


@query(f"""with {LEDGER_SQL}, s as (select conv_id, person, arg_min(name, turn) as name from m where not chair group by all)
  select conv_id, item, ballot, person, name, case when flag in ('A', 'N') then flag else 'NEPRIHLASEN' end as flag, excused from i join b using (item) join s using (conv_id) join v using (ballot, person) where person <> 2""")
def debate_ledger(t: Tables) -> DataFrame:
    m, b, v = _ledger_parts(t)
    deputies = t.region.select((F.col("r_regionkey") % 2).cast("bigint").alias("person"))
    return V.ledger(m, b, v, "conv_id", "item", "turn", "ballot", "person", "name", "flag", ["A", "N"], "NEPRIHLASEN", "chair", deputies)


@query(f"""with {LEDGER_SQL}, g as (select l_orderkey as ballot, l_linestatus as club, count(*) filter (where l_returnflag = 'A') as pro, count(*) filter (where l_returnflag = 'N') as against from lineitem group by all),
  n as (select ballot, string_agg(club || ':' || pro || ':' || against, ',' order by club) as clubs from g group by ballot)
  select conv_id, item, ballot, case ballot % 3 when 0 then 'SUBSTANTIVE_FINAL' when 1 then 'PROCEDURAL_AGENDA' else 'SUBSTANTIVE_AMENDMENT' end as kind, ballot % 3 <> 1 as substantive, result = 'A' as passed, clubs
  from i join b using (item) left join n using (ballot)""")
def ledger_ballots(t: Tables) -> DataFrame:
    m, b, _ = _ledger_parts(t)
    tallies = t.lineitem.groupBy(F.col("l_orderkey").alias("ballot"), F.col("l_linestatus").alias("club")).agg(F.count_if(F.col("l_returnflag") == "A").alias("pro"), F.count_if(F.col("l_returnflag") == "N").alias("against"))
    facts = V.ballot_facts(b, tallies, "ballot", "subject", "result", "club")
    text = F.array_join(F.transform("groups", lambda x: F.concat_ws(":", x["club"], x["pro"].cast("string"), x["against"].cast("string"))), ",")
    out = V.of_debates(facts.select("ballot", "item", "kind", "substantive", "passed", text.alias("clubs")), m, "conv_id", "item", "turn")
    return out.select("conv_id", "item", "ballot", "kind", "substantive", "passed", "clubs")


@query("""with g as (select l_orderkey, l_suppkey from lineitem where l_linenumber = 1 group by all),
  p as (select l_suppkey as person from orders join g on l_orderkey = o_orderkey where o_orderstatus = 'F'
    union all select o_custkey % 100 from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from g)) select person, count(*) as bills from p group by person""")
def submitted_bills(t: Tables) -> DataFrame:
    bills = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("bill"), (F.col("o_custkey") % 100).alias("single"))
    group = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("bill"), F.col("l_suppkey").alias("person"))
    return V.submitted_bills(bills, group, "bill", "person", "single")


RECONCILE_SQL = """declared as (select o_orderkey as ballot, 'A' as flag, o_orderkey % 3 as declared from orders where o_orderkey % 2 = 0),
  counted as (select l_orderkey as ballot, l_returnflag as flag, count(*) as counted from lineitem where l_returnflag = 'A' group by all),
  bad as (select coalesce(c.ballot, d.ballot) as ballot, 'A' as flag, coalesce(counted, 0) as counted, declared from counted c full join declared d on c.ballot = d.ballot
    where coalesce(counted, 0) is distinct from declared)"""


def _discrepancies(t: Tables) -> DataFrame:
    declared = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("ballot"), F.lit("A").alias("flag"), (F.col("o_orderkey") % 3).alias("declared"))
    votes = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("ballot"), F.col("l_returnflag").alias("flag"))
    return V.reconcile(votes, declared, "ballot", "flag")


@query(f"with {RECONCILE_SQL} select ballot, flag, counted, declared from bad")
def tally_reconcile(t: Tables) -> DataFrame:
    return _discrepancies(t)


@query(f"""with {RECONCILE_SQL}, v as (select l_orderkey as ballot, l_suppkey as person, min(l_returnflag) as flag, min(l_linestatus) as club from lineitem group by all)
  select o_orderkey as ballot, o_custkey % 100 as person, v.flag, v.flag <> 'R' as present, v.club, o_orderstatus as result, 'ballot/' || o_orderkey as url, o_custkey % 3 = 0 and o_custkey % 2 = 0 as excused
  from orders join v on v.ballot = o_orderkey and v.person = o_custkey % 100 where o_orderkey not in (select ballot from bad)""")
def resolve_vote(t: Tables) -> DataFrame:
    asked = t.orders.select(
        F.col("o_orderkey").alias("ballot"), (F.col("o_custkey") % 100).alias("person"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("deputy"), (F.col("o_custkey") % 3 == 0).alias("excused")
    )
    votes = t.lineitem.groupBy(F.col("l_orderkey").alias("ballot"), F.col("l_suppkey").alias("person")).agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("club"))
    ballots = t.orders.select(F.col("o_orderkey").alias("ballot"), F.col("o_orderstatus").alias("result"), F.concat(F.lit("ballot/"), F.col("o_orderkey").cast("string")).alias("url"))
    return V.resolve_vote(asked, votes, _discrepancies(t), "ballot", "person", "flag", "R", ["club"], ballots, "deputy", "excused").drop("deputy")


@query("""select l_orderkey, string_agg(s_name || '=' || l_returnflag, ',' order by s_name, l_returnflag) as votes, count(*) filter (where l_linenumber <= 3) as substantive,
  count(*) filter (where l_linenumber > 3) as procedural from lineitem join supplier on l_suppkey = s_suppkey group by l_orderkey""")
def votes_by_ballot(t: Tables) -> DataFrame:
    v = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_name", "l_returnflag", (F.col("l_linenumber") <= 3).alias("sub"))
    out = V.votes_by_ballot(v, "l_orderkey", "s_name", "l_returnflag", "sub")
    return out.withColumn("votes", F.array_join(F.transform("votes", lambda x: F.concat(x["s_name"], F.lit("="), x["l_returnflag"])), ","))


@query(f"""with {IV_SQL} select 'CLUB_MEMBERSHIP:' || user_id || ':' || label || ':' || since as fact_id, 'CLUB_MEMBERSHIP' as predicate, user_id::varchar as subject, label as object,
    seq::varchar as literal, since as valid_from, until as valid_to from iv
  union all select 'VOTE_CAST:' || l_suppkey || ':' || l_orderkey || ':' || l_shipdate::date, 'VOTE_CAST', l_suppkey::varchar, l_orderkey::varchar, max(l_returnflag), l_shipdate::date, l_shipdate::date
  from lineitem group by l_suppkey, l_orderkey, l_shipdate""")
def to_facts(t: Tables) -> DataFrame:
    member = V.to_facts(intervals(t), "CLUB_MEMBERSHIP", F.col("user_id"), F.col("label"), F.col("seq"), F.col("since"), F.col("until"))
    cast = t.lineitem.groupBy("l_suppkey", "l_orderkey", F.to_date("l_shipdate").alias("d")).agg(F.max("l_returnflag").alias("flag"))
    return member.unionByName(V.to_facts(cast, "VOTE_CAST", F.col("l_suppkey"), F.col("l_orderkey"), F.col("flag"), F.col("d"), F.col("d")))


@query(f"""with {IV_SQL} select user_id::varchar as subject, count(*) as facts, min(since) as first_from from iv group by user_id""")
def facts_for_subject(t: Tables) -> DataFrame:
    facts = V.to_facts(intervals(t), "CLUB_MEMBERSHIP", F.col("user_id"), F.col("label"), F.col("seq"), F.col("since"), F.col("until"))
    return E.count_facts(E.facts_for_subject(facts, predicate="CLUB_MEMBERSHIP"))


@query(f"""with {IV_SQL}, p as (select e.event_id, e.user_id, (select arg_min(label, seq) from iv where iv.user_id = e.user_id and (since is null or e.ts::date >= since)
    and (until is null or e.ts::date <= until)) as label from events e where event_type = 'click')
  select event_id, user_id, case when user_id % 17 = 0 then 'MINISTR' when label like 'signup%' then 'KOALICE' when label like 'purchase%' then 'OPOZICE' else 'NEZARAZEN' end as role_at from p""")
def role_at(t: Tables) -> DataFrame:
    probes = t.events.where("event_type = 'click'").select("event_id", "user_id", F.to_date("ts").alias("d"))
    p = T.interval_at(probes, intervals(t), "user_id", "d", "label", "seq")
    side = F.when(F.col("label").startswith("signup"), "KOALICE").when(F.col("label").startswith("purchase"), "OPOZICE")
    return V.role_at(p, F.col("user_id") % 17 == 0, side).select("event_id", "user_id", "role_at")


@query("""with e as (select event_id, user_id, event_type, ts::date as d, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
  select event_id, user_id, coalesce(before in ('click', 'view') and event_type in ('click', 'view') and before <> event_type and d >= date '2024-01-10', false) as flip from e""")
def side_flip(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("d"), before.alias("before"))
    return e.select("event_id", "user_id", V.side_flip(F.col("before"), F.col("event_type"), ["click", "view"], F.col("d"), F.lit("2024-01-10").cast("date")).alias("flip"))


GATE_SQL = f"""{CLAIM_SQL}, stored as (select event_id, ballot + case when event_id % 19 = 0 then 100000000 else 0 end as ballot, person, stance,
    case when event_id % 7 = 0 then 'PRO' else vote end as vote, case when event_id % 5 = 0 then 'SHODA' when vote = 'JINAK' then 'NEHLASOVAL' when vote = stance then 'SHODA' else 'NESHODA' end as agreement from cv),
  g as (select s.*, o_orderkey is null as no_ballot, a.l_orderkey is not null as annulled, v.vote as data_vote from stored s left join orders on o_orderkey = s.ballot
    left join (select distinct l_orderkey from lineitem where l_tax = 0.08) a on a.l_orderkey = s.ballot left join votes v on v.ballot = s.ballot and v.person = s.person)"""


def _gated(t: Tables) -> DataFrame:
    from ..operators import gates as G

    c = _claim_votes(t)
    right = V.agreement(F.col("stance"), F.col("vote"))
    stored = c.select(
        "event_id", (F.col("ballot") + F.when(F.col("event_id") % 19 == 0, 100000000).otherwise(0)).alias("ballot"), "person", "stance",
        F.when(F.col("event_id") % 7 == 0, V.PRO).otherwise(F.col("vote")).alias("vote"), F.when(F.col("event_id") % 5 == 0, "SHODA").otherwise(right).alias("agreement"),
    )
    votes = V.one_vote(t.lineitem, F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_returnflag"), "A", "N", "data_vote")
    ballots = t.orders.select(F.col("o_orderkey").alias("ballot"))
    annulled = t.lineitem.where("l_tax = 0.08").select(F.col("l_orderkey").alias("ballot"))
    return G.gate_agreement(stored, ballots, annulled, votes)


REASON_SQL = """case when no_ballot then 'ballot missing' when annulled then 'ballot annulled' when person is null then 'no person' when data_vote is null then 'no vote'
    when vote = 'PRO' and data_vote = 'PROTI' or vote = 'PROTI' and data_vote = 'PRO' then 'direction differs' when vote in ('PRO', 'PROTI') and data_vote = 'JINAK' then 'vote without direction'
    when agreement <> case when data_vote = 'JINAK' then 'NEHLASOVAL' when data_vote = stance then 'SHODA' else 'NESHODA' end then 'agreement differs' end"""


@query(f"""with {GATE_SQL} select event_id, ballot, person, {REASON_SQL} as reason, {REASON_SQL} is null as verified from g""")
def gate_agreement(t: Tables) -> DataFrame:
    return _gated(t).select("event_id", "ballot", "person", "reason", "verified")


@query(f"""with {GATE_SQL} select event_id, ballot, person, case when event_id % 3 = 0 then 'not approved' else {REASON_SQL} end as reason from g""")
def gate_approved(t: Tables) -> DataFrame:
    from ..operators import gates as G

    return G.gate_approved(_gated(t), F.col("event_id") % 3 != 0).select("event_id", "ballot", "person", "reason")
