"""Speeches and ballots out of the record's pages, as splits and extractions over many pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Marks of the record's pages.
SPEECH_MARK = r"<!--###(\d+)#(\d*)\|(\d*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|@@-->"
SPEECH_FIELDS = ("kind", "person_id", "clock", "flag", "title", "first_name", "last_name", "note")
SPEECH_ANCHOR = r'(?s)<b><a href="[^"]*"\s+id="(r\d+)">.*?</a></b>\s*:?'
TURN_MARK = r"<!--\s*turn\s+(\d+)\s*-->"
BALLOT_LINK = r"hlasy\.sqw\?G=(\d+)"
FURNITURE = (r'(?s)<div class="media-links[^"]*">.*?</div>', r'(?s)<p class="status[^"]*">.*?</p>', r'(?s)<div class="document-nav[^"]*">.*?</div>')
MEMBER_ROW = r'(?s)<li><span class="flag ([\w-]+)">[^<]*</span>\s*<a href="detail\.sqw\?id=(\d+)[^"]*">(.*?)</a></li>'
GROUP_HEAD = r"(?s)<h2[^>]*><span>([^(<]+)\("
VOTE_OF_FLAG = {"yes": "PRO", "no": "PROTI", "refrained": "ZDRZEL_SE", "not-logged-in": "NEPRIHLASEN", "excused": "NEPRIHLASEN"}
SUMMARY = {"Ano": "PRO", "Ne": "PROTI", "Zdržel se": "ZDRZEL_SE", "Nepřihlášen": "NEPRIHLASEN", "Omluven": "NEPRIHLASEN"}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern, or null."""
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit)


def content_region(html: Column) -> Column:
    """The record itself, without what stands around it and without the furniture in it."""
    start = F.greatest(F.instr(html, 'id="main-content"'), F.lit(1))
    rest = F.substring(html, start, F.length(html))
    ends = [F.when(F.instr(rest, m) > 1, F.instr(rest, m)) for m in ('<a id="_d"', '<a name="_d"', "<!--/ Body")]
    cut = F.when(F.coalesce(*ends).isNull(), rest).otherwise(F.substring(rest, F.lit(1), F.least(*ends) - 1))
    for pattern in FURNITURE:
        cut = F.regexp_replace(cut, pattern, " ")
    return cut


def section_title(html: Column) -> Column:
    """The marked heading of the section, else the label after its date, else the page's title."""
    marked = X.html_flat(_found(html, r"(?s)<!--###1#-->(.*?)<!--@@-->"))
    label = F.btrim(F.regexp_extract(X.html_flat(_found(html, r'(?s)<p class="date">(.*?)</p>')), r"^[^,]*,(.+)$", 1))
    label = F.when(label != "", F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label))))
    return F.coalesce(F.when(marked != "", marked), label, X.html_flat(_found(html, r"(?s)<title>(.*?)</title>")), F.lit(""))


def speeches_from_html(pages: DataFrame, url: str, html: str) -> DataFrame:
    """One row for each marked speech of each page: url, ord, the mark's fields, anchor, turn, ballots, section, text.

    The turn is that of the last turn mark before the speech, else the one in the file name.
    Marks without all fields start no speech.
    """
    parts = F.split(content_region(F.col(html)), r"(?=<!--###\d+#\d*\|)")
    rows = pages.select(url, section_title(F.col(html)).alias("section"), F.posexplode(parts).alias("pos", "block"))
    seen = F.element_at(F.regexp_extract_all("block", F.lit(TURN_MARK), F.lit(1)), -1)
    turns = F.when(F.regexp_count("block", F.lit(TURN_MARK)) > 0, seen.cast("int"))
    before = F.last(turns, ignorenulls=True).over(Window.partitionBy(url).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    default = F.regexp_extract(url, r"(?:^|/)b(\d{3})\d{5}\.html?$", 1).try_cast("int")
    rows = rows.withColumn("turn", F.coalesce(before, default)).where(F.regexp_like("block", F.lit(f"^{SPEECH_MARK}")))
    body = F.regexp_replace("block", f"^{SPEECH_MARK}", "")
    anchor = _found(F.col("block"), SPEECH_ANCHOR)
    spoken = F.when(anchor.isNull(), body).otherwise(F.regexp_replace(body, f"(?s)^.*?{SPEECH_ANCHOR.removeprefix('(?s)')}", ""))
    fields = [X.html_flat(F.regexp_extract("block", SPEECH_MARK, i + 1)).alias(name) for i, name in enumerate(SPEECH_FIELDS)]
    return rows.select(
        url, F.row_number().over(Window.partitionBy(url).orderBy("pos")).alias("ord"), *fields, F.coalesce(anchor, F.lit("")).alias("anchor"), "turn",
        F.array_sort(F.array_distinct(F.regexp_extract_all("block", F.lit(BALLOT_LINK), F.lit(1)))).alias("ballots"), "section", X.html_paragraphs(spoken).alias("text"),
    )


def ballots_from_html(pages: DataFrame, url: str, html: str) -> DataFrame:
    """One row for each ballot page: url, session, number, date, clock, subject, result, declared (map)."""
    text = X.html_flat(_found(F.col(html), r"(?s)<h1[^>]*>(.*?)</h1>"))
    clock = r"(\d{1,2}:\d{2}(?::\d{2})?)"
    head = X.html_flat(F.substring_index(html, '<ul class="results">', 1))
    counts: dict[str, list[Column]] = {}
    for label, value in SUMMARY.items():
        counts.setdefault(value, []).append(F.regexp_extract(head, rf"(?:^|\s){label}:\s*(\d+)", 1).try_cast("int"))
    total = {v: F.when(F.coalesce(*c).isNotNull(), sum((F.coalesce(x, F.lit(0)) for x in c), F.lit(0))) for v, c in counts.items()}
    declared = F.map_filter(F.create_map(*[x for v, c in total.items() for x in (F.lit(v), c)]), lambda k, v: v.isNotNull())
    return pages.select(
        url, F.regexp_extract(text, r"(\d+)\.\s*schůze", 1).try_cast("int").alias("session"), F.regexp_extract(text, r"(\d+)\.\s*hlasování", 1).try_cast("int").alias("number"),
        X.worded_date(text).alias("date"), _found(text, clock).alias("clock"), F.btrim(F.regexp_extract(text, clock + "(.*)$", 2)).alias("subject"),
        F.upper(_found(X.html_flat(F.col(html)), r"(?iuU)(NÁVRH\s+(?:NE)?BYL\s+PŘIJAT)")).alias("result"), declared.alias("declared"),
    )


def votes_from_html(pages: DataFrame, url: str, html: str) -> DataFrame:
    """One row for each member of each ballot page: url, person_id, name, club, flag, vote, known.

    The club is the last heading before the row; an unknown flag counts as not logged in.
    """
    parts = F.split(F.col(html), r"(?=<h2\b)")
    rows = pages.select(url, F.posexplode(parts).alias("pos", "part"))
    group = [F.regexp_extract_all("part", F.lit(MEMBER_ROW), F.lit(i)) for i in (1, 2, 3)]
    rows = rows.withColumn("club", F.last(_found(F.col("part"), GROUP_HEAD), ignorenulls=True).over(Window.partitionBy(url).orderBy("pos")))
    rows = rows.select(url, F.coalesce(X.flat_space(F.col("club")), F.lit("")).alias("club"), F.explode(F.arrays_zip(group[0].alias("flag"), group[1].alias("person_id"), group[2].alias("name"))).alias("m"))
    vote = F.try_element_at(F.create_map(*[F.lit(x) for kv in VOTE_OF_FLAG.items() for x in kv]), F.col("m.flag"))
    return rows.select(url, "m.person_id", X.html_flat(F.col("m.name")).alias("name"), "club", "m.flag", F.coalesce(vote, F.lit("NEPRIHLASEN")).alias("vote"), vote.isNotNull().alias("known"))


def commitments_from_json(rows: DataFrame, chapter: str, answer: str, text: str) -> DataFrame:
    """Quoted commitments of a model's answer: chapter, id, quote, char_start, char_end; quotes that are not in the text go."""
    parsed = rows.select(chapter, text, F.explode(F.from_json(X.strip_fences(F.col(answer)), "array<string>")).alias("one"))
    quote = F.btrim(F.from_json("one", "citace string")["citace"])
    out = parsed.select(chapter, text, quote.alias("quote")).withColumn("char_start", F.instr(text, F.col("quote")) - 1).where((F.col("quote") != "") & (F.col("char_start") >= 0))
    key = F.concat(F.lit("pz-"), F.substring(F.sha1(F.concat_ws("::", chapter, "quote")), 1, 16))
    return out.select(chapter, key.alias("id"), "quote", "char_start", (F.col("char_start") + F.length("quote")).alias("char_end"))
