"""Text, markup, clock and key functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R

#: Java flags: case-insensitive and Unicode classes, so that Czech letters are letters.
FLAGS = "(?iuU)"


def clean_speech(text: Column, prefixes: Sequence[str] = R.SPEECH_PREFIXES) -> Column:
    """A trimmed text without the prefixes at its start, taken off until none is left."""
    pattern = f"{FLAGS}^(?:\\s*(?:{'|'.join(prefixes)})\\s*)+"
    return F.regexp_replace(F.trim(text), pattern, "")


def removed_offset(text: Column, cleaned: Column) -> Column:
    """Where the cleaned text begins in the text; its whole length if nothing is left."""
    return F.when(cleaned == "", F.length(text)).otherwise(F.length(text) - F.length(cleaned) - (F.length(text) - F.length(F.rtrim(text))))


def occurrences(text: Column, snippet: Column) -> Column:
    """Zero-based starts of all occurrences, overlapping ones too."""
    n = F.length(text) - F.length(snippet)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(snippet)) == snippet)
    return F.when((snippet != "") & (n >= 0) & text.contains(snippet), at)


def nearest_occurrence(text: Column, snippet: Column, hint: Column) -> Column:
    """The occurrence nearest to the hint (ties: the earlier), the first without a hint, null without any."""
    # one search forward from the hint and one backward, in the reversed text, so that a long text costs its length
    hint = F.coalesce(hint, F.lit(0))
    after = F.position(snippet, text, F.greatest(hint, F.lit(0)) + 1) - 1
    past = F.length(text) - F.length(snippet)
    behind = past - (F.position(F.reverse(snippet), F.reverse(text), F.greatest(past - hint + 1, F.lit(0)) + 1) - 1)
    before = F.when((hint > 0) & (behind <= past), behind)
    after = F.when(after >= 0, after)
    nearest = F.when(before.isNull() | (after.isNotNull() & (after - hint < hint - before)), after).otherwise(before)
    return F.when((snippet != "") & (past >= 0), nearest)


def repair_span(text: Column, snippet: Column, start: Column, end: Column) -> Column:
    """The start of a span: as stated if the text there is the snippet, else the nearest occurrence, else null."""
    right = F.substring(text, start + 1, F.greatest(end - start, F.lit(0))) == snippet
    return F.when(right & (start >= 0), start).otherwise(nearest_occurrence(text, snippet, start))


def first_rule(text: Column, groups: Sequence[tuple[str, Sequence[str]]], rest: str | None) -> Column:
    """The name of the first group that has a pattern found in the text."""
    out = None
    for name, patterns in groups:
        hit = F.regexp_like(text, F.lit(FLAGS + "(?:" + "|".join(patterns) + ")"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if rest is None else out.otherwise(rest)


def classify_ballot(subject: Column, groups: Sequence[tuple[str, Sequence[str]]] = R.BALLOT_RULES, substantive: str = "SUBSTANTIVE", rest: str = "PROCEDURAL_OTHER") -> Column:
    """Struct of kind and whether it is substantive; an unknown subject is procedural."""
    kind = first_rule(F.trim(F.coalesce(subject, F.lit(""))), groups, rest)
    return F.struct(kind.alias("kind"), kind.startswith(substantive).alias("substantive"))


def verbal_commitment(text: Column, groups: Sequence[tuple[str, Sequence[str]]] = R.COMMITMENTS) -> Column:
    """The first stance stated in the last two fifths of a text, or null."""
    start = F.floor(F.length(text) * F.lit(0.6)).cast("int")
    return first_rule(F.substring(text, start + 1, F.length(text)), groups, None)


def bill_number(title: Column) -> Column:
    """The number of the first bill named in a title, as text; null without one."""
    found = F.regexp_extract(title, FLAGS + r"tisk\w*\s+(\d+)", 1)
    return F.when(found != "", found)


def bill_of_title(title: Column) -> Column:
    """The number of the bill that a debate's title names between slashes, as text; null without one."""
    found = F.regexp_extract(title, FLAGS + R.BILL_IN_TITLE, 1)
    return F.when(found != "", found)


def phase(title: Column, rest: str = R.PHASE_REST) -> Column:
    """The phase that a title names, by the first rule; `rest` for a title with a bill only, null with neither."""
    return F.coalesce(first_rule(title, R.PHASES, None), F.when(bill_of_title(title).isNotNull(), rest))


def claim_text(text: Column, subject: Column, predicate: Column, obj: Column, frame: Column) -> Column:
    """The text if there is one, else the parts that are not empty joined by blanks, the time frame in brackets unless it is unknown."""
    part = lambda c: F.when(c != "", c)
    framed = F.when((frame != "") & (frame != R.NO_FRAME), F.concat(F.lit("("), frame, F.lit(")")))
    return F.coalesce(text, F.btrim(F.concat_ws(" ", part(subject), part(predicate), part(obj), framed)))


def short_topic(title: Column) -> Column:
    """A title without its leading number and trailing bill clause; the title itself if nothing is left."""
    cut = F.btrim(F.regexp_replace(F.regexp_replace(title, r"^\s*\d+\.\s*", ""), FLAGS + r"\s*/?\s*(?:sněmovní\s+)?tisk\w*\s+\d+\s*/?.*$", ""))
    return F.when(cut == "", title).otherwise(cut)


# Entities that the pages use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _unescape(text: Column) -> Column:
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def html_flat(html: Column) -> Column:
    """Tags become blanks, entities their characters, runs of white space one blank."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = _unescape(F.regexp_replace(text, r"(?s)<[^>]*>", " "))
    return F.btrim(F.regexp_replace(text, r"[\s ]+", " "))


def html_paragraphs(html: Column) -> Column:
    """One line for each paragraph or break; unknown entities become blanks; empty lines go."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"[\r\n]+", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|br|h[1-6]|li|div)\b[^>]*>", "\n")
    text = _unescape(F.regexp_replace(text, r"(?s)<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"&[a-zA-Z]+;", " "), r"[ \t ]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: x != ""), "\n")


def flat_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\s ]+", " "))


def quote_reason(page: Column, quote: Column) -> Column:
    """Why a quote does not stand in a page text, or null: both are compared with white space flattened."""
    return F.when(F.coalesce(quote, F.lit("")) == "", "no quote").when(page.isNull(), "no page").when(~flat_space(page).contains(flat_space(quote)), "quote not found")


def attributed_reason(text: Column, quote: Column, surname: Column, most: int = 400, around: int = 300) -> Column:
    """Why a quote may not be put in someone's mouth: empty, too long, not in the text, or no surname near it."""
    at = F.instr(text, quote)
    start = F.greatest(at - around, F.lit(1))
    near = F.substring(text, start, at - start + F.length(quote) + around)
    return (
        F.when(F.coalesce(quote, F.lit("")) == "", "empty").when(F.length(quote) > most, "too long").when(F.coalesce(at, F.lit(0)) == 0, "not in text")
        .when(~F.lower(near).contains(F.lower(surname)), "name not near")
    )


# Latin letters with marks and the letters under them.
MARKED = "áàâäãåāąćčçďđéèêëēęěíìîïīłľĺńňñóòôöõōøŕřśšşťţúùûüūůűýÿźžż"
PLAIN = "aaaaaaaacccddeeeeeeeiiiiilllnnnooooooorrsssttuuuuuuuyyzzz"


def slugify(text: Column) -> Column:
    """Lower case without marks, other characters as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM[:SS], alone or after the date of an ISO time; null if it is neither."""
    p = r"^(?:\d{4}-\d{2}-\d{2}[T ])?(\d{1,2}):(\d{2})(?::(\d{2}))?"
    part = lambda i: F.regexp_extract(text, p, i)
    number = lambda i: F.coalesce(F.try_to_number(F.when(part(i) != "", part(i)), F.lit("99")).cast("int"), F.lit(0))
    return F.when(part(1) != "", number(1) * 3600 + number(2) * 60 + number(3))


def clock_text(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def worded_date(text: Column, months: Sequence[str] = R.MONTHS) -> Column:
    """The first "day. month year" of a text with the month as a word in any case; null for another word or a day that does not exist."""
    pattern = r"(?U)(\d{1,2})\.\s*([^\W\d_]+)\s*(\d{4})"
    day, name, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    month = F.array_position(F.array(*map(F.lit, months)), F.lower(name))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "yyyy-M-d"))


def host(url: Column) -> Column:
    """The host of a URL in lower case without a leading www.; null for what is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def suffix_tier(rows: DataFrame, host: str, lookup: DataFrame, domain: str, tier: str) -> DataFrame:
    """Rows with the tier of their host or of the longest parent domain with two labels at least; null for none.

    Candidates are looked up by equality; the lookup is one row a domain, and Spark broadcasts
    it by its measured size. Rows must be distinct.
    """
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tries = rows.select(*rows.columns, F.posexplode_outer(parents).alias("_rank", "_domain"))
    found = tries.join(lookup.select(F.col(domain).alias("_domain"), F.col(tier).alias("_tier")), "_domain", "left")
    return found.groupBy(*rows.columns).agg(F.min_by("_tier", F.when(F.col("_tier").isNotNull(), F.col("_rank"))).alias(tier))


def stable_key(*parts: Column) -> Column:
    """sha256 of the parts joined by '::'."""
    return F.sha2(F.concat_ws("::", *parts), 256)


def short_key(prefix: str, *parts: Column) -> Column:
    """A prefix and the first 16 hex digits of sha1 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def strip_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


CLAIM_KEYS = ("subject", "predicate", "object", "timeFrame", "condition", "claimCategory", "speechAct", "rawSpan", "extractionConfidence")


def claims_from_json(rows: DataFrame, item: str, answer: str, text: str, categories: Sequence[str], acts: Sequence[str]) -> DataFrame:
    """Claims of a model's answer: item, claim_id, the fields, char_start and char_end.

    The answer, without fences, must be a JSON array; an element without all nine keys, with an
    unknown category or act, or whose span is not in the text is dropped. The id counts from 1
    in the answer, so that gaps stay. A broken answer gives no rows.
    """
    raw = rows.select(item, text, F.posexplode_outer(F.from_json(strip_fences(F.col(answer)), "array<string>")).alias("n", "one")).where("one is not null")
    keys = F.json_object_keys("one")
    parsed = raw.where(F.forall(F.array(*map(F.lit, CLAIM_KEYS)), lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))))
    parsed = parsed.withColumn("c", F.from_json("one", ", ".join(f"{k} string" for k in CLAIM_KEYS)))
    kind, act = (F.upper(F.btrim(F.col(f"c.{k}"))) for k in ("claimCategory", "speechAct"))
    start = F.instr(text, F.col("c.rawSpan")) - 1
    out = parsed.where((F.col("c.rawSpan") != "") & (start >= 0) & kind.isin(*categories) & act.isin(*acts))
    plain = [F.col(f"c.{k}").alias(k) for k in CLAIM_KEYS if k not in ("claimCategory", "speechAct", "extractionConfidence")]
    return out.select(
        item, F.concat(F.col(item).cast("string"), F.lit("-c"), (F.col("n") + 1).cast("string")).alias("claim_id"), *plain, kind.alias("claimCategory"), act.alias("speechAct"),
        F.expr("try_cast(c.extractionConfidence as double)").alias("confidence"), start.alias("char_start"), (start + F.length("c.rawSpan")).alias("char_end"),
    )


def role_answer(answer: Column) -> Column:
    """Struct of passed, downgrade and defences of a model's answer, with safe defaults for a broken one."""
    parsed = F.from_json(strip_fences(answer), "passed boolean, downgrade string, defences array<string>")
    return F.struct(F.coalesce(parsed["passed"], F.lit(True)).alias("passed"), parsed["downgrade"].alias("downgrade"), F.coalesce(parsed["defences"], F.array().cast("array<string>")).alias("defences"))


def stance_answer(answer: Column, known: Sequence[str] = ("PRO", "PROTI")) -> Column:
    """The stance of a model's answer; unknown or unreadable is NEURCITELNE."""
    said = F.upper(F.btrim(F.from_json(strip_fences(answer), "postoj string")["postoj"]))
    return F.when(said.isin(*known), said).otherwise("NEURCITELNE")


def _read(answer: Column) -> Column:
    """A model's answer as a variant, null unless it is a JSON object."""
    value = F.try_parse_json(strip_fences(answer))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _truth(read: Column, key: str) -> Column:
    """Whether a value of an object is true: not false, null, zero or empty; any other text is true. Null where the key is missing."""
    kind = F.schema_of_variant(F.try_variant_get(read, f"$.{key}", "variant"))
    text = F.try_variant_get(read, f"$.{key}", "string")
    filled = ~text.isin("[]", "{}") & ~F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.when(kind == "BOOLEAN", text == "true").when(kind == "VOID", False).when(kind == "STRING", text != "").otherwise(filled)


def _said(read: Column, key: str, most: int, unread: str) -> Column:
    return F.when(read.isNull(), unread).otherwise(F.substring(F.coalesce(F.try_variant_get(read, f"$.{key}", "string"), F.lit("")), 1, most))


def challenge_answer(answer: Column, unread: str = "unreadable answer") -> Column:
    """Struct of contradiction and reading (at most 250 characters); an unreadable answer is a contradiction, so that nothing is published."""
    read = _read(answer)
    return F.struct(F.coalesce(_truth(read, "rozporMizi"), F.lit(True)).alias("contradiction"), _said(read, "vyklad", 250, unread).alias("reading"))


def pairing_check(answer: Column, unread: str = "unreadable answer") -> Column:
    """Struct of holds and reading (at most 200 characters); a pairing holds only if the answer says so."""
    read = _read(answer)
    return F.struct(F.coalesce(_truth(read, "parovaniPlati"), F.lit(False)).alias("holds"), _said(read, "vyklad", 200, unread).alias("reading"))


def proposed_pairs(rows: DataFrame, answer: str, offered: DataFrame, key: str) -> DataFrame:
    """Rows whose answer names one of the offered keys: the key and the reason (at most 200 characters); others go.

    offered has the column `key` (text), and is joined by it, so that its length does not matter.
    """
    read = F.from_json(strip_fences(F.col(answer)), "cisloTisku string, zduvodneni string")
    named = rows.withColumn(key, F.btrim(read["cisloTisku"])).withColumn("reason", F.substring(F.coalesce(read["zduvodneni"], F.lit("")), 1, 200))
    return named.where(~F.col(key).isin("", "0")).join(offered.select(key).distinct(), key, "left_semi")


def narrative(*parts: tuple[Column, Column], rest: str) -> Column:
    """The texts whose condition holds, joined by a bar; rest if none does."""
    joined = F.concat_ws(" | ", *[F.when(cond, text) for cond, text in parts])
    return F.when(joined == "", rest).otherwise(joined)


def role_of(title: Column, speaker: Column) -> Column:
    """What stands before the speaker's name in a title; the whole title where the name does not follow anything."""
    at = F.instr(title, speaker)
    return F.btrim(F.when((at > 1) & (speaker != ""), F.substr(title, F.lit(1), at - 1)).otherwise(title))


def is_chair(role: Column, roles: Sequence[str] = R.CHAIR_ROLES) -> Column:
    """Whether a role begins with that of a chair; false for a null role."""
    return F.coalesce(F.greatest(*[role.startswith(r) for r in roles]), F.lit(False))


def payload_json(fields: dict[str, Column], optional: dict[str, Column] | None = None, most: int | None = None) -> Column:
    """A request body: the fields in order, texts cut to `most` characters, null as null; an optional one that is null or empty is left out."""
    short = lambda c: F.substring(c, 1, most) if most else c
    # a null field keeps its key, so the object is put together from its members
    member = lambda k, c: F.concat(F.to_json(F.array(F.lit(k))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(k)))) - 2), F.lit(":"), value(c))
    value = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    given = [member(k, short(c)) for k, c in fields.items()]
    given += [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", member(k, short(c))) for k, c in (optional or {}).items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *given), F.lit("}"))
