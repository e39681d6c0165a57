"""Text, markup, clock and key functions bound to documents, pages, conversations and events.

The phrase lists here are words of the given texts; the library's own defaults are those of
`functions.rules`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as X
from ..operators import pairs as P
from .registry import Tables, query


@query(r"""with c as (select doc_id, trim(text) as text, regexp_replace(trim(text), '^(?i:\s*(?:the\s+\w+|of|und|le\s+)\s*)+', '') as clean from documents)
  select doc_id, clean, case when clean = '' then len(text) else len(text) - len(clean) end as removed from c""")
def clean_speech(t: Tables) -> DataFrame:
    text = F.trim("text")
    d = t.documents.select("doc_id", text.alias("text"), X.clean_speech(F.col("text"), (r"the\s+[0-9A-Za-z_]+", "of", "und", r"le\s+")).alias("clean"))
    return d.select("doc_id", "clean", F.when(F.col("clean") == "", F.length("text")).otherwise(F.length("text") - F.length("clean")).cast("bigint").alias("removed"))


SPAN_SQL = r"""s as (select doc_id, text, substr(text, 1 + (doc_id * 7919 % greatest(len(text) - 5, 1))::integer, 6) as snippet, (doc_id * 7919 % greatest(len(text) - 5, 1) + case when doc_id % 3 = 0 then 0 else doc_id % 40 end)::integer as start from documents where len(text) >= 6),
  p as (select *, case when strpos(substr(text, start + 1), snippet) > 0 then start + strpos(substr(text, start + 1), snippet) - 1 end as after,
    case when strpos(reverse(substr(text, 1, start + 5)), reverse(snippet)) > 0 then least(start + 5, len(text)) - 6 - (strpos(reverse(substr(text, 1, start + 5)), reverse(snippet)) - 1) end as before0 from s),
  q as (select *, case when before0 < start then before0 end as before from p),
  n as (select doc_id, case when before is null or after - start < start - before then after else before end as nearest, strpos(text, snippet) - 1 as first from q)"""


def _spans(t: Tables) -> DataFrame:
    """A snippet from a place anywhere in each text, and a start that is right or up to 39 characters late."""
    d = t.documents.where(F.length("text") >= 6)
    place = F.col("doc_id") * 7919 % (F.length("text") - 5)
    start = place + F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 40)
    return d.select("doc_id", "text", F.substring(F.col("text"), (1 + place).cast("int"), F.lit(6)).alias("snippet"), start.cast("int").alias("start"))


@query(f"with {SPAN_SQL} select doc_id, nearest, first from n")
def nearest_occurrence(t: Tables) -> DataFrame:
    text, snippet = F.col("text"), F.col("snippet")
    out = _spans(t).select("doc_id", X.nearest_occurrence(text, snippet, F.col("start")).cast("bigint").alias("nearest"), X.nearest_occurrence(text, snippet, F.lit(None).cast("int")).cast("bigint").alias("first"))
    return out.where("first is not null")


@query(f"""with {SPAN_SQL} select s.doc_id, case when substr(text, start + 1, 6) = snippet then start else nearest end::bigint as start from s left join n using (doc_id)""")
def repair_span(t: Tables) -> DataFrame:
    return _spans(t).select("doc_id", X.repair_span(F.col("text"), F.col("snippet"), F.col("start"), F.col("start") + 6).cast("bigint").alias("start"))


@query(r"""select doc_id, case when upper(trim(k)) in ('ROZPOR', 'CONTRADICTION') then 'CONTRADICTION' when upper(trim(k)) = 'SHIFT' then 'VALUE_SHIFT' end as kind, case when s in ('LOW', 'MEDIUM', 'HIGH') then s else 'MEDIUM' end as severity
  from (select doc_id, case doc_id % 4 when 0 then ' rozpor ' when 1 then 'shift' when 2 then 'PROCEDURAL' else 'contradiction' end as k, case doc_id % 3 when 0 then 'HIGH' when 1 then 'bad' else 'LOW' end as s from documents)
  where upper(trim(k)) in ('ROZPOR', 'CONTRADICTION', 'SHIFT')""")
def normalise_annotation(t: Tables) -> DataFrame:
    from ..operators.rows import normalise_annotations

    d = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, " rozpor ").when(F.col("doc_id") % 4 == 1, "shift").when(F.col("doc_id") % 4 == 2, "PROCEDURAL").otherwise("contradiction").alias("kind"),
        F.when(F.col("doc_id") % 3 == 0, "HIGH").when(F.col("doc_id") % 3 == 1, "bad").otherwise("LOW").alias("severity"),
    )
    return normalise_annotations(d, "kind", "severity", {"ROZPOR": "CONTRADICTION", "CONTRADICTION": "CONTRADICTION", "SHIFT": "VALUE_SHIFT", "PROCEDURAL": "PROCEDURAL"})


@query(r"""select doc_id, case when y = '' then null else y::integer end as year, 'doc ' || doc_id || case when doc_id % 4 = 0 then '' else ' (' || s || ')' end as claim_text
  from (select doc_id, regexp_extract(s, '\b(19[5-9]\d|20[0-4]\d)\b', 1) as y, s from (select doc_id, 'v roce ' || (1940 + doc_id % 120) as s from documents))""")
def extract_year(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.concat(F.lit("v roce "), (1940 + F.col("doc_id") % 120).cast("string")).alias("s"))
    tail = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("("), F.col("s"), F.lit(")")))
    return d.select("doc_id", P.extract_year(F.col("s")).alias("year"), F.concat_ws(" ", F.lit("doc"), F.col("doc_id").cast("string"), tail).alias("claim_text"))


RULES = (("AGENDA", ("^the ", "order")), ("FINAL", ("as a whole", r"\*\*")), ("AMENDMENT", ("tion of", "ing the")))


@query(r"""select doc_id, case when regexp_matches(trim(text), '(?i)(^the |order)') then 'AGENDA' when regexp_matches(trim(text), '(?i)(as a whole|\*\*)') then 'FINAL'
  when regexp_matches(trim(text), '(?i)(tion of|ing the)') then 'AMENDMENT' else 'PROCEDURAL_OTHER' end as kind from documents""")
def classify_ballot(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.classify_ballot(F.col("text"), RULES)["kind"].alias("kind"))


@query(r"""select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when l_linenumber = 7 then 'procedural vote' when l_suppkey % 9 = 0 then 'side missing' when l_returnflag = upper(trim(l_linestatus)) then 'agrees' else 'mismatch' end as reason from lineitem""")
def mismatch_reason(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 7, "PROCEDURAL").otherwise("SUBSTANTIVE")
    said = F.when(F.col("l_suppkey") % 9 != 0, F.col("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", S.mismatch_reason(kind, said, F.col("l_linestatus")).alias("reason"))


@query(r"""with d as (select doc_id, substr(text, floor(len(text) * 0.6)::integer + 1) as tail from documents)
  select doc_id, case when regexp_matches(tail, '(?i) was ') then 'PRO' when regexp_matches(tail, '(?i) (from|que) ') then 'PROTI' when regexp_matches(tail, '(?i)und') then 'ZDRZEL_SE' end as stance from d""")
def verbal_commitment(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.verbal_commitment(F.col("text"), (("PRO", (" was ",)), ("PROTI", (" (from|que) ",)), ("ZDRZEL_SE", ("und",)))).alias("stance"))


@query(r"""select o_orderkey, case when o_orderkey % 3 <> 0 then (o_custkey)::varchar end as bill, case when o_orderkey % 3 <> 0 then 'Navrh ' || o_orderstatus else o_orderkey || '. Navrh' end as topic from orders where o_orderkey % 3 <> 0
  union all select o_orderkey, null, 'Navrh' from orders where o_orderkey % 3 = 0""")
def bill_number(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 3 != 0, F.concat(key, F.lit(". Navrh "), F.col("o_orderstatus"), F.lit(" /sněmovní tisk "), F.col("o_custkey").cast("string"), F.lit("/ - první čtení"))).otherwise(F.concat(key, F.lit(". Navrh")))
    return t.orders.select("o_orderkey", X.bill_number(title).alias("bill"), X.short_topic(title).alias("topic"))


@query(r"""with a as (select page_id, regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g') as h from pages),
  b as (select page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') as h from a),
  c as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as h from b)
  select page_id, trim(regexp_replace(h, '[\s ]+', ' ', 'g')) as flat from c""")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_flat(F.col("html")).alias("flat"))


@query()
def html_paragraphs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_paragraphs(F.col("html")).alias("paragraphs"))


@query(r"""with p as (select page_id, html, url, regexp_extract_all(html, '(?is)<(h[1-6]|p)\b[^>]*>(.*?)</(?:h[1-6]|p)\s*>', 1) as kinds from pages)
  select page_id, len(kinds)::bigint as blocks, len(list_filter(kinds, lambda x: lower(x) <> 'p'))::bigint as headings from p""")
def blocks_from_html(t: Tables) -> DataFrame:
    from ..operators.rows import html_blocks

    b = html_blocks(t.pages, "page_id", "html")
    counts = b.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("tag") != "p").alias("headings"))
    return t.pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("headings", F.lit(0)).alias("headings"))


@query(r"""with q as (select d.doc_id, d.text, b.text as quote from documents d join benchmark b on d.doc_id % 40 = b.item_id)
  select doc_id, case when quote = '' then 'no quote' when text is null then 'no page' when not contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) then 'quote not found' end as reason from q""")
def quote_check(t: Tables) -> DataFrame:
    b = t.benchmark.select(F.col("item_id"), F.col("text").alias("quote"))
    return t.documents.withColumn("item_id", F.col("doc_id") % 40).join(b, "item_id").select("doc_id", X.quote_reason(F.col("text"), F.col("quote")).alias("reason"))


@query(r"""with q as (select doc_id, text, case doc_id % 5 when 0 then '' when 1 then 'missing words here' when 2 then repeat('x', 401) else substr(text, 30, 25) end as quote, case doc_id % 2 when 0 then 'THE' else 'Zeppelinx' end as name from documents where text is not null),
  r as (select *, strpos(text, quote) as at_pos from q)
  select doc_id, case when quote = '' then 'empty' when len(quote) > 400 then 'too long' when at_pos = 0 then 'not in text'
    when not contains(lower(substr(text, greatest(at_pos - 300, 1), at_pos - greatest(at_pos - 300, 1) + len(quote) + 300)), lower(name)) then 'name not near' end as reason from r""")
def attributed_quote_check(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    quote = F.when(k == 0, "").when(k == 1, "missing words here").when(k == 2, "x" * 401).otherwise(F.substring("text", 30, 25))
    name = F.when(F.col("doc_id") % 2 == 0, "THE").otherwise("Zeppelinx")
    return t.documents.where("text is not null").select("doc_id", X.attributed_reason(F.col("text"), quote, name).alias("reason"))


@query(r"""with s as (select conv_id, turn, text, coalesce(sum(len(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as a from conversations where text is not null),
  w as (select conv_id, string_agg(text, ' ' order by turn) as whole from s group by conv_id),
  asked as (select w.conv_id, substr(whole, (greatest(1, len(text) - 9) + a)::bigint, 5 + (turn * 7 + w.conv_id) % 40) as quote from w join s using (conv_id) union select conv_id, substr(text, 3, 8) from s union select conv_id, 'nowhere in it' from w),
  q as (select conv_id, quote, strpos(whole, quote) - 1 as p from w join asked using (conv_id) where quote <> '')
  select conv_id, quote, max(turn) as segment from q join s using (conv_id) where s.a <= q.p and q.p >= 0 group by conv_id, quote""")
def locate_in_segments(t: Tables) -> DataFrame:
    """Quotes that run over the border of each message with the next, short ones inside, and one that nobody said."""
    from ..operators.rows import locate_in_segments as locate

    c = t.conversations.where("text is not null").select("conv_id", "turn", "text")
    following = F.collect_list(F.substring("text", 1, 50)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 50))
    rest = F.concat(F.substr("text", F.greatest(F.lit(1), F.length("text") - 9)), F.when(F.size(following) > 0, F.concat(F.lit(" "), F.array_join(following, " "))).otherwise(""))
    over = c.withColumn("rest", rest).select("conv_id", F.substr("rest", F.lit(1), (5 + (F.col("turn") * 7 + F.col("conv_id")) % 40).cast("int")).alias("quote"))
    quotes = over.union(c.select("conv_id", F.substring("text", 3, 8))).union(c.select("conv_id", F.lit("nowhere in it"))).where("quote <> ''").distinct()
    return locate(c, quotes, "conv_id", "turn", "text", "quote").select("conv_id", "quote", F.col("turn").alias("segment"))


@query(r"""select p_partkey, trim(regexp_replace(strip_accents(lower(p_name || ' ' || p_brand || ' Žluťoučký-kůň!')), '[^a-z0-9]+', '-', 'g'), '-') as slug from part""")
def slugify(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slugify(F.concat_ws(" ", "p_name", "p_brand", F.lit("Žluťoučký-kůň!"))).alias("slug"))


@query(r"""select event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::integer as seconds,
  case when hour(ts) > 0 then printf('%d:%02d:%02d', hour(ts), minute(ts), second(ts)) else printf('%d:%02d', minute(ts), second(ts)) end as shown from events""")
def clock_helpers(t: Tables) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    e = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, text).otherwise(F.date_format("ts", "H:mm:ss")).alias("s"))
    return e.select("event_id", X.clock_seconds(F.col("s")).alias("seconds")).withColumn("shown", X.clock_text(F.col("seconds")))


HOST_SQL = r"""h as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') as host from pages)"""


@query(f"with {HOST_SQL} select page_id, host, ends_with(host, '.example.com') as official from h")
def host_predicates(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.host(F.col("url")).alias("host")).withColumn("official", F.col("host").endswith(".example.com"))


TIER_SQL = f"""{HOST_SQL}, lookup as (select * from (values ('example.com', 2), ('blog.example.com', 4), ('example.org', 1), ('com', 9)) v(domain, tier)),
  r as (select page_id, host, (select arg_max(tier, len(domain)) from lookup where (host = domain or ends_with(host, '.' || domain)) and contains(domain, '.')) as tier from h)"""


def _tiers(t: Tables) -> DataFrame:
    lookup = t.spark.createDataFrame([("example.com", 2), ("blog.example.com", 4), ("example.org", 1), ("com", 9)], "domain string, tier int")
    return X.suffix_tier(t.pages.select("page_id", X.host(F.col("url")).alias("host")), "host", lookup, "domain", "tier")


@query(f"with {TIER_SQL} select page_id, host, tier from r")
def longest_suffix_join(t: Tables) -> DataFrame:
    return _tiers(t)


@query(f"with {TIER_SQL} select page_id, host from r where coalesce(tier <= 3, true)")
def source_allowed(t: Tables) -> DataFrame:
    return _tiers(t).where(F.coalesce(F.col("tier") <= 3, F.lit(True))).select("page_id", "host")


@query(f"""with {HOST_SQL}, p as (select *, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/]+([^?#]*)', 1), '/+$', '') as path from h)
  select page_id, url from p where starts_with(host, 'blog.') or contains(path, '/fr/') or contains(path, '.html') or path = '/news'""")
def listing_page_filter(t: Tables) -> DataFrame:
    from ..operators.rows import listing_pages

    return listing_pages(t.pages, "url", F.col("host").startswith("blog."), ("/fr/", ".html"), ("/news",)).select("page_id", "url")


@query(r"""select page_id, regexp_extract(url, '[?&]page=(\d+)', 1)::integer as page from pages where regexp_matches(url, '[?&]page=\d+')""")
def event_filter_by_name(t: Tables) -> DataFrame:
    from ..operators.rows import numbered_by_name

    return numbered_by_name(t.pages, "url", r"[?&]page=(\d+)", "page").select("page_id", "page")


@query(r"""select doc_id, case when (contains(lower(text), 'ation') or contains(lower(text), 'keit')) and doc_id % 2 = 0 then 'EXTERNAL_SHOCK' when contains(lower(text), 'from') then 'COALITION_COMPROMISE'
  when (doc_id % 3 = 0 and n_chars / 10000.0 < 0.82) or contains(lower(text), 'que') then 'PROCEDURAL_EVASION' else 'OPPORTUNISTIC_FLIP' end as cause from documents""")
def flip_attribution(t: Tables) -> DataFrame:
    c = S.flip_attribution(F.col("text"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("n_chars") / 10000.0, ("ation", "keit"), ("from",), ("que",))
    return t.documents.select("doc_id", c.alias("cause"))


@query(r"""select doc_id, case when regexp_matches(lower(text), 'was|avec') then 'CHAIR' when contains(lower(text), 'from') then 'TOPIC' when contains(lower(text), 'los') then 'ROLE' else 'BORDERLINE' end as class from documents""")
def classify_dismissal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.keyword_class(F.col("text"), (("CHAIR", ("was", "avec")), ("TOPIC", ("from",)), ("ROLE", ("los",))), "BORDERLINE").alias("class"))


@query(r"""select doc_id, passed and (n < 2 or same) as warning from (select doc_id, doc_id % 2 = 0 as passed, case when doc_id % 3 = 0 then 1 else 2 end as n, doc_id % 5 = 0 and doc_id % 3 <> 0 as same from documents)""")
def divergence_warning(t: Tables) -> DataFrame:
    d = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.when(F.col("doc_id") % 5 == 0, "a").otherwise("b")))
    return t.documents.select("doc_id", S.divergence_warning(F.col("doc_id") % 2 == 0, d).alias("warning"))


@query(r"""select doc_id, coalesce(nullif(concat_ws(' | ', case when n_chars > 2000 then 'long' end, case when lang = 'en' then 'english' end, case when doc_id % 7 = 0 then source end), ''), 'nothing to say') as story from documents""")
def narrative(t: Tables) -> DataFrame:
    story = X.narrative((F.col("n_chars") > 2000, F.lit("long")), (F.col("lang") == "en", F.lit("english")), (F.col("doc_id") % 7 == 0, F.col("source")), rest="nothing to say")
    return t.documents.select("doc_id", story.alias("story"))


@query(r"""select doc_id, sha256('model::' || text) as cache_key, 'pz-' || substr(sha1(doc_id || '|' || lang), 1, 16) as id from documents where text is not null and lang is not null""")
def stable_key(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null and lang is not null")
    return d.select("doc_id", X.stable_key(F.lit("model"), F.col("text")).alias("cache_key"), X.short_key("pz-", F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@query("""with p as (select conv_id, turn, case turn % 5 when 0 then 'Předsedkyně PSP' when 1 then 'Místopředseda PSP' when 2 then 'Poslanec' when 3 then '' end as role, upper(role) as name from conversations)
  select conv_id, turn, trim(case when role is null then null else role end) as role, coalesce(turn % 5 < 2, false) as chair from p""")
def chair_predicate(t: Tables) -> DataFrame:
    """Roles that stand before the speaker's name in a title, and whether they are a chair's."""
    role = F.when(F.col("turn") % 5 == 0, "Předsedkyně PSP").when(F.col("turn") % 5 == 1, "Místopředseda PSP").when(F.col("turn") % 5 == 2, "Poslanec").when(F.col("turn") % 5 == 3, "")
    c = t.conversations.select("conv_id", "turn", role.alias("given"), F.upper("role").alias("name"))
    c = c.withColumn("title", F.concat("given", F.lit("   "), F.col("name"), F.lit(" ")))
    found = F.when(F.btrim("given") == "", "").otherwise(X.role_of(F.col("title"), F.col("name")))
    return c.select("conv_id", "turn", found.alias("role"), X.is_chair(found).alias("chair"))


@query(r"""select doc_id, '{"MESSAGE_ID":' || doc_id || ',"SPEAKER":' || case when source is null then 'null' else '"' || source || '"' end || ',"CLEAN_TEXT":' || case when text is null then 'null' else
    '"' || replace(replace(replace(replace(replace(substr(text, 1, 500), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') || '"' end || case when doc_id % 2 = 0 and lang <> '' then ',"LANG":"' || lang || '"' else '' end || '}' as payload from documents""")
def payload_json(t: Tables) -> DataFrame:
    """The request for each document: null texts stay, long ones are cut, an empty language is left out."""
    fields = {"MESSAGE_ID": F.col("doc_id"), "SPEAKER": F.col("source"), "CLEAN_TEXT": F.substring("text", 1, 500)}
    return t.documents.select("doc_id", X.payload_json(fields, {"LANG": F.when(F.col("doc_id") % 2 == 0, F.col("lang"))}).alias("payload"))


@query(r"""select doc_id, case doc_id % 3 when 0 then true when 1 then false else true end as passed, case when doc_id % 3 < 2 then 2 else 0 end as defences, case doc_id % 4 when 0 then 'PRO' when 1 then 'PROTI' else 'NEURCITELNE' end as stance from documents""")
def parse_role_response(t: Tables) -> DataFrame:
    body = F.when(F.col("doc_id") % 3 == 0, '{"passed": true, "defences": ["a", "b"]}').when(F.col("doc_id") % 3 == 1, '{"passed": false, "defences": ["a", "b"]}').otherwise("not json")
    said = F.when(F.col("doc_id") % 4 == 0, '{"postoj": "pro"}').when(F.col("doc_id") % 4 == 1, '{"postoj": " PROTI "}').when(F.col("doc_id") % 4 == 2, '{"postoj": "maybe"}').otherwise("broken")
    a = X.role_answer(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return t.documents.select("doc_id", a["passed"].alias("passed"), F.size(a["defences"]).alias("defences"), X.stance_answer(said).alias("stance"))


@query(r"""select doc_id, doc_id || '-c1' as claim_id, 0::bigint as char_start, len(text)::bigint as char_end from documents where len(text) > 0""")
def claims_from_json(t: Tables) -> DataFrame:
    d = t.documents.where(F.length("text") > 0)
    claim = F.to_json(F.struct(
        F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"), F.lit("t").alias("timeFrame"), F.lit("c").alias("condition"), F.lit(" policy ").alias("claimCategory"),
        F.lit("own_stance").alias("speechAct"), F.col("text").alias("rawSpan"), F.lit("0.9").alias("extractionConfidence"),
    ))
    d = d.withColumn("answer", F.concat(F.lit("```json\n["), claim, F.lit(', {"subject": "no keys"}]\n```')))
    out = X.claims_from_json(d, "doc_id", "answer", "text", ["POLICY"], ["OWN_STANCE"])
    return out.select("doc_id", "claim_id", F.col("char_start").cast("bigint"), F.col("char_end").cast("bigint"))


@query(r"""select conv_id, turn, substr(text, 1, 40) || ' vs ' || substr(prev, 1, 40) as label, coalesce(case when turn % 3 > 0 then 'd' || turn end, 'f' || (turn - 1)) as past_date, coalesce(case when turn % 2 = 0 then 'u' || turn end, '') as url,
    round(coalesce(case when turn % 4 > 0 then turn / 7.0 end, 0.5), 4) as score
  from (select *, lag(text) over (partition by conv_id order by turn) as prev from conversations where text is not null) where prev is not null""")
def candidate_record(t: Tables) -> DataFrame:
    """A candidate of each message against the one before it."""
    from ..operators.records import candidate_record as record

    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t.conversations.where("text is not null").withColumn("prev", prev).where("prev is not null")
    claim = F.struct(F.col("text").alias("rawSpan"), F.lit(None).cast("string").alias("timeFrame"))
    past = F.struct(F.col("prev").alias("rawSpan"), F.concat(F.lit("f"), (F.col("turn") - 1).cast("string")).alias("timeFrame"))
    told = F.when(F.col("turn") % 3 > 0, F.concat(F.lit("d"), F.col("turn").cast("string")))
    url = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("u"), F.col("turn").cast("string")))
    r = c.select("conv_id", "turn", record(claim, past, told, url, F.lit(None).cast("string"), F.when(F.col("turn") % 4 > 0, F.col("turn") / 7.0), "?").alias("r"))
    return r.select("conv_id", "turn", F.col("r.shortBadgeLabel").alias("label"), F.col("r.proof.pastDate").alias("past_date"), F.col("r.proof.sourceUrl").alias("url"), F.round("r.confidenceScore", 4).alias("score"))
