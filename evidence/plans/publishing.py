"""Dumps, answers, gates and records of what is published, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import gates as G
from ..operators import pages as H
from ..operators import records as D
from ..operators import votes as V
from ..sources import dumps
from .registry import Tables, query
from .voting import CLAIM_SQL, _claim_votes


def _cols(df: DataFrame, *fields: Column) -> DataFrame:
    """Fields as the texts of a raw row; nulls are empty."""
    cols = F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return df.select(cols.alias("cols"), F.monotonically_increasing_id().alias("seq"))


def _raw_dumps(t: Tables) -> dict[str, DataFrame]:
    c, term, empty = F.col, F.lit("1"), F.lit("")
    tail = [F.when(c("o_orderkey") % 11 == 0, "x").otherwise(c("o_custkey").cast("string")), *[F.lit(k) for k in (2, 3, 4, 5, 6)], empty, c("o_orderstatus")]
    return {
        "sessions": _cols(t.nation, c("n_nationkey"), c("n_regionkey") % 2, F.when(c("n_nationkey") % 5 == 0, "none").otherwise(c("n_nationkey").cast("string"))),
        "agenda": _cols(t.supplier, c("s_suppkey"), c("s_nationkey"), F.when(c("s_suppkey") % 2 == 0, c("s_suppkey")), empty, F.when(c("s_suppkey") % 3 == 0, "").when(c("s_suppkey") % 3 == 1, "x").otherwise("7"), c("s_name")),
        "turns": _cols(t.customer, c("c_custkey"), c("c_nationkey") % 2, c("c_nationkey"), c("c_custkey")),
        "records": _cols(t.orders, c("o_custkey"), c("o_orderkey"), c("o_orderkey"), c("o_orderkey") % 4),
        "ballots": _cols(t.orders, c("o_orderkey"), c("o_custkey") % 2, c("o_custkey"), c("o_orderkey"), F.when(c("o_orderkey") % 3 > 0, c("o_orderkey") % 3), F.lit("01.01.2026"), F.lit("10:00"), *tail),
        "votes": _cols(t.lineitem, c("l_suppkey"), c("l_orderkey"), c("l_returnflag")),
        "annulled": _cols(t.lineitem.where("l_tax = 0.08"), c("l_orderkey")),
        "excuses": _cols(t.customer, F.when(c("c_custkey") % 5 == 0, term).otherwise("2"), c("c_custkey"), F.lit("01.01.2026"), empty, empty),
    }


@query("""with se as (select n_nationkey as id from nation where n_regionkey % 2 = 1 and n_nationkey % 5 <> 0), tu as (select c_custkey as id, c_nationkey as session from customer where c_nationkey % 2 = 1),
    ba as (select o_orderkey as id, case when o_orderkey % 3 > 0 then o_orderkey % 3 else 0 end as n from orders where o_custkey % 2 = 1 and o_orderkey % 11 <> 0)
  select 'sessions' as dump, id::varchar as a, '1' as b, id::bigint as n from se union all
  select 'agenda', s_suppkey::varchar, case when s_suppkey % 2 = 0 then s_suppkey::varchar end, case when s_suppkey % 3 = 2 then 7 end from supplier where s_nationkey in (select id from se) union all
  select 'turns', id::varchar, '1', session from tu union all
  select 'records', o_orderkey::varchar, (o_orderkey % 4)::varchar, session from orders join tu on id = o_custkey where o_orderkey % 4 <> 0 union all
  select 'ballots', id::varchar, '', n from ba union all select 'votes', l_suppkey::varchar, l_returnflag, l_orderkey from lineitem where l_orderkey in (select id from ba) union all
  select distinct 'annulled', l_orderkey::varchar, null, null::bigint from lineitem where l_tax = 0.08 and l_orderkey in (select id from ba) union all
  select 'excuses', c_custkey::varchar, '', null from customer where c_custkey % 5 = 0""")
def vote_dumps(t: Tables) -> DataFrame:
    p = dumps.parse_vote_dumps(_raw_dumps(t), "1")
    none = F.lit(None)
    digest = {"sessions": ("session_id", "organ", "session"), "agenda": ("item_id", "bill_id", "item"), "turns": ("turn_id", "organ", "session"), "records": ("person", "item_id", "session"),
              "ballots": ("ballot", "title", "item"), "votes": ("deputy", "code", "ballot"), "annulled": ("ballot", none, none), "excuses": ("deputy", "since", none)}
    col = lambda x: F.col(x) if isinstance(x, str) else x
    out = None
    for name, (a, b, n) in digest.items():
        one = p[name].select(F.lit(name).alias("dump"), col(a).alias("a"), col(b).cast("string").alias("b"), col(n).cast("bigint").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select o_orderkey, case when o_orderkey % 4 < 2 then o_custkey::varchar end as bill, case o_orderkey % 4 when 0 then '1. čtení' when 1 then 'Obecná rozprava' when 2 then 'Ústní interpelace' end as phase from orders""")
def debate_phase(t: Tables) -> DataFrame:
    k, bill = F.col("o_orderkey") % 4, F.concat(F.lit("Návrh /sněmovní tisk "), F.col("o_custkey").cast("string"), F.lit("/"))
    title = F.when(k == 0, F.concat(bill, F.lit(" - prvé čtení"))).when(k == 1, bill).when(k == 2, "Ústní interpelace").otherwise("Zahájení")
    return t.orders.select("o_orderkey", X.bill_of_title(title).alias("bill"), X.phase(title).alias("phase"))


@query("""select p_partkey, case when p_partkey % 5 = 0 then p_name else trim(concat_ws(' ', nullif(p_brand, ''), case when p_partkey % 3 > 0 then p_type end, case when p_size % 2 = 0 then '(' || p_size || ')' end)) end as claim from part""")
def claim_text(t: Tables) -> DataFrame:
    frame = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("NEURČENO")
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name"))
    return t.part.select("p_partkey", X.claim_text(text, F.col("p_brand"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise(""), F.lit(None).cast("string"), frame).alias("claim"))


@query("""select doc_id, doc_id % 5 <> 1 as contradiction, case doc_id % 5 when 2 then 'unreadable answer' when 4 then '' else substr(coalesce(text, ''), 1, 250) end as reading, doc_id % 5 = 0 as holds from documents""")
def model_verdicts(t: Tables) -> DataFrame:
    k, said = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    flags = lambda flag: F.to_json(F.struct(flag.alias("rozporMizi"), flag.alias("parovaniPlati"), said.alias("vyklad")))
    answer = F.when(k == 0, flags(F.lit(True))).when(k == 1, flags(F.lit(False))).when(k == 2, "not readable").when(k == 3, F.to_json(F.struct(said.alias("vyklad")))).otherwise("{}")
    challenge, pairing = X.challenge_answer(answer), X.pairing_check(answer)
    return t.documents.select("doc_id", challenge["contradiction"].alias("contradiction"), challenge["reading"].alias("reading"), pairing["holds"].alias("holds"))


@query("select o_orderkey, (o_custkey * 2)::varchar as bill, o_orderpriority as reason from orders where o_orderkey % 7 > 0 and o_custkey <> 0 and o_custkey * 2 in (select c_custkey from customer)")
def pairing_answer(t: Tables) -> DataFrame:
    answer = F.to_json(F.struct((F.col("o_custkey") * 2).alias("cisloTisku"), F.col("o_orderpriority").alias("zduvodneni")))
    rows = t.orders.withColumn("answer", F.when(F.col("o_orderkey") % 7 > 0, answer).otherwise("{}"))
    return X.proposed_pairs(rows, "answer", t.customer.select(F.col("c_custkey").cast("string").alias("bill")), "bill").select("o_orderkey", "bill", "reason")


@query("""select doc_id, case doc_id % 7 when 0 then 'no proof' when 1 then 'quote not found' when 2 then 'ballot missing' when 3 then 'session differs' when 4 then 'date differs' when 5 then 'no number' end as reason from documents where len(trim(text)) > 0 and text is not null""")
def annotation_gate(t: Tables) -> DataFrame:
    # proofs that quote their document and name a ballot; six of seven are spoilt in one way
    d = t.documents.where("length(trim(text)) > 0")
    k = F.col("doc_id") % 7
    ref = F.when(k == 5, "hlasování").otherwise(F.concat(
        F.lit("Hlasování č. "), (F.col("doc_id") + F.when(k == 2, 1000000000).otherwise(0)).cast("string"), F.lit(", "), F.when(k == 3, "15").otherwise("14"), F.lit(". schůze ("), F.when(k == 4, "5").otherwise("14"), F.lit(". 4. 2026)")))
    quote = F.when(k == 1, F.concat(F.substring(F.trim("text"), 1, 40), F.lit("☃"))).otherwise(F.substring(F.trim("text"), 1, 60))
    proof = F.when(k != 0, F.struct(quote.alias("pastQuote"), F.concat(F.lit("page/"), F.col("doc_id").cast("string")).alias("sourceUrl"), ref.alias("votingBallotId")))
    pages = d.select(F.concat(F.lit("page/"), F.col("doc_id").cast("string")).alias("url"), "text")
    ballots = d.select(F.col("doc_id").cast("string").alias("ballot"), F.lit(14).alias("session"), F.to_date(F.lit("2026-04-14")).alias("date"))
    return G.gate_annotations(d.select("doc_id", proof.alias("proof")), pages, ballots).select("doc_id", "reason")


@query("""select doc_id, case doc_id % 8 when 0 then 'missing explanation' when 1 then 'unknown type;unknown severity' when 2 then 'span out of range' when 3 then 'span is not the snippet' when 4 then 'score too low;tier differs'
    when 5 then 'proof without pastDate;unknown vote' when 6 then 'bad media time;media without address;check without result' else '' end as errors from documents where text is not null and len(text) >= 5""")
def annotation_schema(t: Tables) -> DataFrame:
    d, k, c = t.documents.where("length(text) >= 5"), F.col("doc_id") % 8, F.lit
    proof = F.struct(F.substring("text", 1, 5).alias("pastQuote"), F.when(k == 5, "").otherwise("2026").alias("pastDate"), c("x").alias("pastContext"), c("u").alias("sourceUrl"), F.when(k == 5, "?").alias("voteRecorded"))
    a = F.struct(
        c(0).alias("start"), F.when(k == 2, F.length("text") + 1).otherwise(5).alias("end"), F.concat(F.substring("text", 1, 5), F.when(k == 3, "!").otherwise("")).alias("targetSnippet"),
        F.when(k == 1, "OTHER").otherwise("VALUE_SHIFT").alias("type"), F.when(k == 1, "none").otherwise("HIGH").alias("severity"), c("label").alias("shortBadgeLabel"), F.when(k != 0, "why").alias("explanation"), proof.alias("proof"),
        F.when(k == 4, 0.5).otherwise(0.96).alias("confidenceScore"), c("PUBLISHED").alias("presentationTier"), c("NEUTRAL").alias("nliRelation"), c("").alias("claimCategory"),
        F.when(k == 6, F.struct(c(-1).alias("exactTimestampSeconds"), c("").alias("archiveUrl"))).alias("mediaEvidence"), F.when(k == 6, F.struct(c(None).cast("boolean").alias("passed"))).alias("adversarialCheck"),
    )
    return d.withColumn("a", a).select("doc_id", F.array_join(G.annotation_errors(F.col("a"), F.col("text")), ";").alias("errors"))


@query("""with m as (select conv_id * 1000 + turn as id, role, text from conversations)
  select a.id as pair_id, round(a.id % 7 / 7.0, 4) as contradiction, trim(coalesce(a.role, '') || ' says  ') as a_statement, coalesce(a.text, '') as a_quote, b.id as b_message, coalesce(b.role, '') as b_url from m a join m b on b.id = a.id - 1""")
def lead_record(t: Tables) -> DataFrame:
    m = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    claim = lambda text: F.struct(F.col("role").alias("subject"), F.lit("says").alias("predicate"), F.lit("").alias("object"), F.lit(None).cast("string").alias("timeFrame"), text.alias("rawSpan"))
    leads = m.select(F.col("id").alias("pair_id"), (F.col("id") % 7 / 7.0).alias("contradiction"), F.lit(0.97).alias("similarity"), F.col("id").alias("message_a"), (F.col("id") - 1).alias("message_b"), claim(F.col("text")).alias("claim_a"), claim(F.lit("")).alias("claim_b"))
    none = F.lit(None).cast("string")
    messages = m.select(F.col("id").alias("message_id"), none.alias("speaker"), none.alias("person"), none.alias("party"), none.alias("date"), F.col("role").alias("url"))
    return D.lead_records(leads, messages).select(
        "pair_id", "contradiction", F.col("side_a.statement").alias("a_statement"), F.col("side_a.quote").alias("a_quote"), F.col("side_b.message_id").alias("b_message"), F.col("side_b.url").alias("b_url")
    )


@query(f"""with {CLAIM_SQL} select 'pv-' || event_id || '-' || ballot as id, person, 'chapters#' || bill as chapter_url, 'bill=' || bill as bill_url, session as final_session, vote = 'PRO' as passed, '' as date from cv""")
def program_record(t: Tables) -> DataFrame:
    c = _claim_votes(t)
    none = F.lit(None).cast("string")
    record = D.program_record(
        F.struct(F.col("event_id").alias("id"), F.lit("q").alias("quote")), F.struct(F.col("bill").alias("id"), F.lit(1).alias("place"), F.lit("t").alias("title")), F.struct(F.col("bill").alias("number"), F.lit("b").alias("title")),
        F.struct("ballot", none.alias("url"), F.lit(1).alias("number"), "session", none.alias("date"), F.col("vote").alias("result"), (F.col("vote") == V.PRO).alias("passed")), F.lit("why"), F.array(F.col("person")), "chapters", "bill=",
    )
    return c.withColumn("r", record).select("r.id", "person", F.col("r.pledge.url").alias("chapter_url"), F.col("r.bill.url").alias("bill_url"), F.col("r.final.session").alias("final_session"), F.col("r.final.passed").alias("passed"), F.col("r.final.date").alias("date"))


@query(r"""select 'http://h/b' || lpad(conv_id::varchar, 8, '0') || '.htm' as url, turn::varchar as person_id, coalesce(role, '') as last_name, 'r' || turn as anchor, (conv_id // 100000)::integer as turn,
    case when turn % 2 = 0 then '' else conv_id::varchar end as ballots, 'Conversation ' || conv_id as section, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) as text from conversations where text is not null""")
def speeches_from_html(t: Tables) -> DataFrame:
    c = t.conversations.where("text is not null")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    link = F.when(F.col("turn") % 2 != 0, F.concat(F.lit('<a href="hlasy.sqw?G='), conv, F.lit('"> </a>'))).otherwise("")
    said = F.btrim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        said = F.replace(said, F.lit(plain), F.lit(written))
    block = F.concat(F.lit("<!--###0#"), turn, F.lit("|90500||||"), F.coalesce("role", F.lit("")), F.lit('||@@--><p><b><a href="/x" id="r'), turn, F.lit('">x</a></b>: '), said, F.lit("</p>"), link)
    pages = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("b"))
    html = F.concat(F.lit('<div id="main-content"><!--###1#-->Conversation '), conv, F.lit("<!--@@-->"), F.array_join(F.transform("b", lambda x: x["block"]), ""))
    pages = pages.select(F.concat(F.lit("http://h/b"), F.lpad(conv, 8, "0"), F.lit(".htm")).alias("url"), html.alias("html"))
    return H.speeches_from_html(pages, "url", "html").select("url", "person_id", "last_name", "anchor", "turn", F.array_join("ballots", ",").alias("ballots"), "section", "text")


@query("""select 'u' || o_orderkey as url, (o_custkey % 90)::integer as session, o_orderkey::integer as number, case when o_orderkey % 11 > 0 then o_orderdate::date end as date, '14:05' as clock, o_orderpriority as subject, case when o_orderstatus = 'F' then 'NÁVRH BYL PŘIJAT' else 'NÁVRH NEBYL PŘIJAT' end as result,
  (o_custkey % 7)::integer as pro, (3 + o_custkey % 5)::integer as away from orders""")
def ballots_from_html(t: Tables) -> DataFrame:
    s = lambda c: c.cast("string")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    months = F.array(*map(F.lit, R.MONTHS))
    month = F.when(key % 11 == 0, F.lit("brumairu")).when(key % 2 == 0, F.upper(months[F.month("o_orderdate") - 1])).otherwise(months[F.month("o_orderdate") - 1])
    worded = F.concat(s(F.day("o_orderdate")), F.lit(". "), month, F.lit(" "), s(F.year("o_orderdate")))
    html = F.concat(
        F.lit("<h1>"), s(cust % 90), F.lit(". schůze, "), s(key), F.lit(". hlasování, "), worded, F.lit(", 14:05 "), F.col("o_orderpriority"), F.lit("</h1><p>NÁVRH "), F.when(F.col("o_orderstatus") == "F", "BYL").otherwise("NEBYL"),
        F.lit(" PŘIJAT</p><p>Ano: "), s(cust % 7), F.lit(" Ne: 1 Nepřihlášen: "), s(cust % 5), F.lit(' Omluven: 3</p><ul class="results"></ul>'),
    )
    out = H.ballots_from_html(t.orders.select(F.concat(F.lit("u"), s(key)).alias("url"), html.alias("html")), "url", "html")
    return out.select("url", "session", "number", "date", "clock", "subject", "result", F.col("declared")["PRO"].alias("pro"), F.col("declared")["NEPRIHLASEN"].alias("away"))


@query("""select 'u' || l_orderkey as url, l_suppkey::varchar as person_id, 'm ' || l_partkey as name, l_linestatus as club, case l_returnflag when 'A' then 'yes' when 'N' then 'no' else 'odd' end as flag, case l_returnflag when 'A' then 'PRO' when 'N' then 'PROTI' else 'NEPRIHLASEN' end as vote,
  l_returnflag in ('A', 'N') as known from lineitem""")
def votes_from_html(t: Tables) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("odd")
    row = F.concat(F.lit('<li><span class="flag '), flag, F.lit('">'), F.col("l_returnflag"), F.lit('</span> <a href="detail.sqw?id='), F.col("l_suppkey").cast("string"), F.lit('&x">m&nbsp;'), F.col("l_partkey").cast("string"), F.lit("</a></li>"))
    groups = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.concat(F.lit("<h2><span>"), F.col("l_linestatus"), F.lit(' (3)</span></h2><ul class="results">'), F.array_join(F.collect_list(row), ""), F.lit("</ul>")).alias("g"))
    pages = groups.groupBy("l_orderkey").agg(F.array_join(F.collect_list("g"), "").alias("html")).select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("url"), "html")
    return H.votes_from_html(pages, "url", "html")


@query("""with q as (select doc_id, text, trim(substr(text, 1 + doc_id % 50, 80)) as quote from documents where text is not null)
  select doc_id, 'pz-' || substr(sha1(doc_id || '::' || quote), 1, 16) as id, quote, (strpos(text, quote) - 1)::integer as char_start, (strpos(text, quote) - 1 + len(quote))::integer as char_end from q where quote <> ''""")
def commitments_from_json(t: Tables) -> DataFrame:
    cited = F.to_json(F.struct(F.concat(F.lit(" "), F.btrim(F.expr("substring(text, 1 + cast(doc_id % 50 as int), 80)")), F.lit(" ")).alias("citace")))
    d = t.documents.where("text is not null").withColumn("answer", F.concat(F.lit("```json\n["), cited, F.lit(', {"citace": "☃ is not there"}, {}]\n```')))
    return H.commitments_from_json(d, "doc_id", "answer", "text")
