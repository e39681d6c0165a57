"""Row filters and small extractions over texts, pages and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import saved

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def normalise_annotations(rows: DataFrame, kind: str, severity: str, aliases: dict[str, str], drop: str = "PROCEDURAL", severities: Sequence[str] = ("LOW", "MEDIUM", "HIGH")) -> DataFrame:
    """Aliases of kinds become canonical, unknown kinds and `drop` go, an unknown severity is MEDIUM."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    known = F.try_element_at(table, F.upper(F.btrim(F.col(kind))))
    good = F.coalesce(F.col(severity).isin(*severities), F.lit(False))
    out = rows.withColumn(kind, known).where(F.col(kind).isNotNull() & (F.col(kind) != drop))
    return out.withColumn(severity, F.when(good, F.col(severity)).otherwise("MEDIUM"))


def substantive(rows: DataFrame, text: str, chair: Column, least: int = 200) -> DataFrame:
    """Speeches of at least `least` characters that no chair gave."""
    return rows.where(~F.coalesce(chair, F.lit(False)) & (F.length(text) >= least))


def without_phrases(rows: DataFrame, text: Column, phrases: Sequence[str], procedural: Column) -> DataFrame:
    """Rows that are not procedural by category and hold none of the phrases."""
    from ..functions.score import any_of

    return rows.where(~F.coalesce(procedural, F.lit(False)) & ~F.coalesce(F.regexp_like(F.lower(text), F.lit(any_of(phrases))), F.lit(False)))


def search(rows: DataFrame, query: str, columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """Rows whose columns, joined by blanks, contain the query in any case; an empty query passes all."""
    out = rows if not query.strip() else rows.where(F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower()))
    return out if only is None else out.where(only)


def listing_pages(pages: DataFrame, url: str, by_host: Column, markers: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """Pages that list others: by a condition on the column host, a marker in the path, or the whole path."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), "/+$", "")
    marked = by_host
    for m in markers:
        marked = marked | path.contains(m)
    return pages.withColumn("host", X.host(F.col(url))).where(marked | path.isin(*exact))


def numbered_by_name(rows: DataFrame, name: str, pattern: str, number: str) -> DataFrame:
    """Rows with the number that the pattern finds in their name; others go."""
    found = F.regexp_extract(name, pattern, 1)
    return rows.where(found != "").withColumn(number, found.cast("int"))


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Headings and paragraphs of pages in their order: key, pos, tag, inner markup."""
    pattern = r"(?is)<(h[1-6]|p)\b[^>]*>(.*?)</(?:h[1-6]|p)\s*>"
    tags, inner = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return pages.select(key, F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("inner"))).alias("pos", "b")).select(key, "pos", F.lower("b.tag").alias("tag"), "b.inner")


def chapters(pages: DataFrame, key: str, html: str, expected: Sequence[str] | None = None, level: str = "h2") -> DataFrame:
    """Text of each chapter of a page, from one heading of the level to the next: key, chapter, title, text.

    A chapter is named by its heading's id, or by the heading's words without one. With expected, a page whose chapters are not exactly these fails the query.
    """
    parts = F.filter(F.split(html, rf"(?i)(?=<{level}\b)"), lambda x: F.regexp_like(x, F.lit(rf"(?i)^<{level}\b")))
    title = lambda part: X.html_flat(F.regexp_extract(part, rf"(?is)<{level}\b[^>]*>(.*?)</{level}>", 1))

    def name(part: Column) -> Column:
        named = F.regexp_extract(part, rf"(?i)^<{level}\b[^>]*\bid=[\"']?([^\"'\s>]+)", 1)
        return F.when(named != "", named).otherwise(X.slugify(title(part)))

    rows = pages.select(key, parts.alias("parts"))
    if expected is not None:
        right = F.array_sort(F.transform("parts", name)) == F.array(*map(F.lit, sorted(expected)))
        rows = rows.where(F.assert_true(right, F.lit("chapters are not the expected ones")).isNull())
    rows = rows.select(key, F.posexplode("parts").alias("pos", "part"))
    text = X.html_paragraphs(F.regexp_replace("part", rf"(?is)^<{level}\b.*?</{level}>", ""))
    return rows.select(key, "pos", name(F.col("part")).alias("chapter"), title(F.col("part")).alias("title"), text.alias("text"))


def locate_in_segments(segments: DataFrame, quotes: DataFrame, group: str, seq: str, text: str, quote: str, size: int = 16, whole: int = 1 << 18) -> DataFrame:
    """The segment of its group in which each quote first begins; quotes may run over segment borders.

    Segments (seq tells those of a group apart) are joined by one blank; null segments are left out, and a null or empty
    quote is not found.

    Segments of a group of up to `whole` characters are joined in one row, in which its quotes are sought. In larger groups a
    quote is cut into pieces, and no text is longer than a segment and a piece (`_by_pieces`).
    """
    known = segments.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(group, F.col(seq).alias("_seq"), F.col(text).alias("_text"))
    quotes = saved(quotes, "quotes")
    asked = quotes.select(group, F.col(quote).alias("_quote")).where(F.length("_quote") > 0).distinct()
    sizes = saved(known.groupBy(group).agg(F.sum(F.length("_text") + 1).alias("_chars")), "sizes")
    small, large = sizes.where(F.col("_chars") <= whole).select(group), sizes.where(F.col("_chars") > whole).select(group)
    parts = F.array_sort(F.collect_list(F.struct("_seq", "_text")))  # as many characters as `whole`
    texts = known.join(small, group, "left_semi").groupBy(group).agg(parts.alias("_parts"))
    texts = texts.select(group, F.array_join("_parts._text", " ").alias("_whole"), F.transform("_parts", lambda x: F.struct(x["_seq"].alias("seq"), (F.length(x["_text"]) + 1).alias("n"))).alias("_parts"))
    hit = asked.join(texts.hint("merge"), group).withColumn("_place", F.position("_quote", "_whole") - 1).where("_place >= 0")
    # the place goes in with the start, as Spark would compute it again for each segment inside the lambda
    start = F.struct(F.lit(0).alias("at"), F.col("_place").alias("place"), F.col("_parts")[0]["seq"].alias("seq"))
    step = lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), a["place"].alias("place"), F.when(a["at"] <= a["place"], x["seq"]).otherwise(a["seq"]).alias("seq"))
    first = hit.select(group, "_quote", F.aggregate("_parts", start, step, lambda a: a["seq"]).alias(seq))
    if not large.isEmpty():
        first = first.union(_by_pieces(known.join(large, group, "left_semi"), asked.join(large, group, "left_semi"), group, seq, size))
    return quotes.join(first.withColumnRenamed("_quote", quote), [group, quote])


def _by_pieces(known: DataFrame, asked: DataFrame, group: str, seq: str, size: int) -> DataFrame:
    """The first segment of each quote of groups that are too large for one row: group, _quote and seq.

    A quote is cut into pieces of `size` characters, the last one ending with it; a segment offers all its runs of
    that length, with those that run into the next segments. Pieces and runs meet by an equality join, and a place
    where all pieces of a quote meet holds it.
    """
    order = Window.partitionBy(group).orderBy("_seq")
    after = F.collect_list(F.substring("_text", 1, size)).over(order.rowsBetween(1, size))  # a blank each, so `size` segments are enough
    placed = known.select(
        group, "_seq", F.coalesce(F.sum(F.length("_text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.length("_text").alias("_n"), F.concat("_text", F.when(F.size(after) > 0, F.concat(F.lit(" "), F.array_join(after, " "))).otherwise("")).alias("_ext"),
    )
    asked = asked.withColumn("_size", F.least(F.length("_quote"), F.lit(size)))
    last = F.length("_quote") - F.col("_size")
    pieces = asked.withColumn("_starts", F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.col("_size")), F.array(last))))
    pieces = pieces.select(group, "_quote", "_size", F.size("_starts").alias("_pieces"), F.explode("_starts").alias("_start"))
    pieces = pieces.withColumn("_run", F.substr("_quote", F.col("_start") + 1, F.col("_size")))
    sizes = asked.groupBy(group).agg(F.collect_set("_size").alias("_sizes"))  # at most `size` numbers
    runs = placed.join(sizes, group).select(group, "_seq", "_from", "_ext", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_at"), "_sizes")
    runs = runs.select(group, "_seq", (F.col("_from") + F.col("_at")).alias("_place"), F.explode(F.transform("_sizes", lambda n: F.substr("_ext", F.col("_at") + 1, n))).alias("_run"))
    met = runs.join(pieces, [group, "_run"]).groupBy(group, "_quote", (F.col("_place") - F.col("_start")).alias("_begin"), "_pieces")
    found = met.agg(F.count_distinct("_start").alias("_met"), F.max(F.when(F.col("_start") == 0, F.col("_seq"))).alias(seq)).where("_met = _pieces")
    return found.groupBy(group, "_quote").agg(F.min_by(seq, "_begin").alias(seq))


def article_date(pages: DataFrame, html: str, as_of: Column) -> DataFrame:
    """Pages with date and reason: one of three metadata keys, else the first valid <time> not after as_of."""
    keys = ("article:published_time", "datePublished", "og:published_time")
    meta = [F.regexp_extract(html, rf"(?is)(?:property|name|itemprop)=[\"']{k}[\"'][^>]*content=[\"']([^\"']{{10}})", 1) for k in keys]
    first = F.coalesce(*[F.when(m != "", m) for m in meta])
    time = F.try_to_date(F.substring(F.regexp_extract(html, r"(?is)<time\b[^>]*datetime=[\"']([^\"']+)", 1), 1, 10), "yyyy-MM-dd")
    date = F.coalesce(first, F.when(time <= as_of, time.cast("string")))
    return pages.withColumn("date", date).withColumn("reason", F.when(date.isNull(), "no usable date"))
