"""Quality rules: measures of each document, and how often its lines occur across documents.

Only DataFrame functions are used. The measures need no shuffle: the five-word windows of a
text are hashed and compared inside its row. For the line rule only line hashes, never
texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

WINDOW = 5


def _repeated_words(words: Column) -> Column:
    """Words inside five-word windows that the text holds twice or more."""
    n = F.size(words)
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def heavy(g: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))
            return covered(F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"])))

        return let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))), twice)

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(heavy(g)))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    with_word = lambda lines: F.filter(lines, lambda x: F.regexp_like(x, F.lit(WORD)))
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeated_words(w).cast("bigint").alias("n_repeat_words")),
    )
    repeats = let(with_word(F.split(text, "\n", -1)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.struct(of_words.alias("w"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"), repeats.cast("bigint").alias("n_dup_lines"))


def normalised_line(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "))


def frequent_lines(docs: DataFrame, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (row_key, pos, host, line, words), and the lines above the limits (host, line)."""
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    keyed = docs.select(_row_key().alias("row_key"), host.alias("host"), F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = keyed.where(F.regexp_like("raw", F.lit(WORD))).select(
        "row_key", "pos", "host", "body", F.xxhash64(normalised_line(F.col("raw"))).alias("line"), F.regexp_count("raw", F.lit(WORD)).alias("words")
    )
    counted = lines.groupBy("host", "line").agg(F.count_distinct("body").alias("n_docs")).where(F.col("n_docs") > least)
    hosts = docs.select(host.alias("host"), F.xxhash64("text").alias("body")).groupBy("host").agg(F.count_distinct("body").alias("host_docs"))
    above = counted.join(hosts, "host").where(F.col("n_docs") > F.lit(share) * F.col("host_docs")).select("host", "line")
    return lines, above


def _row_key() -> Column:
    """A key of doc_id, source and text; nulls are marked, since a hash passes over them."""
    parts = [F.col(c) for c in ("doc_id", "source", "text")]
    return F.xxhash64(*[F.isnull(c) for c in parts], *parts)


def quality_rules(docs: DataFrame, share: float = 0.05, least: int = 20, depleted: float = 0.7, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, the measures, base_failed, the removals and kept.

    docs needs doc_id, text and source (the host). A line is normalised and hashed; it is
    above the limits on a host where more than `least` distinct documents and more than
    `share` of the host's distinct documents have it. Documents with one text on a host count
    once, so that copies alone make no line frequent: what is counted are distinct texts. n_removed_lines and n_removed_words say
    what goes; a document that loses more than `depleted` of its words is rejected, as is one
    with base_failed (under ten words, or over a fifth of them in repeated windows).
    with_text adds clean_text, the text without its removed lines (null for a null text).
    Columns named in carry are passed on.

    Null or empty text: no words, so base_failed. A null source is a host of its own. Rows
    that agree in doc_id, source and text get one verdict, each row its own output row.
    Other columns are not read.
    """
    docs = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("none"), *carry).alias("extra"))
    measured = docs.select("doc_id", "text", "extra", _row_key().alias("row_key"), measures(F.col("text")).alias("m"))
    lines, above = frequent_lines(docs, share, least)
    gone = lines.join(above, ["host", "line"], "left_semi").groupBy("row_key", "pos").agg(F.max("words").alias("words")).groupBy("row_key")
    gone = gone.agg(F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words"), *([F.collect_set("pos").alias("at")] if with_text else []))
    n = F.col("n_words")
    out = (
        measured.select("doc_id", "row_key", "extra", *(["text"] if with_text else []), "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.n_dup_lines", "m.w.n_repeat_words")
        .withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
        .join(gone, "row_key", "left")
        .withColumn("n_removed_lines", F.coalesce("lines", F.lit(0)))
        .withColumn("n_removed_words", F.coalesce("words", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= F.lit(depleted) * n))
    )
    if with_text:
        rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("at"), i))
        out = out.withColumn("clean_text", F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept", *(["clean_text"] if with_text else []), *(F.col(f"extra.`{c}`") for c in carry))


#: The same rows in SQL, with the default parameters.
SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce('=' || source, '-') as host, text as body, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select rid, i, array_to_string(ws[i:i+4], ' ') as gram from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g) where c >= 2),
rep as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from r) group by rid),
l as (select rid, host, body, raw, lower(raw) as low from (select rid, host, body, unnest(string_split(text, chr(10))) as raw from d) where regexp_matches(raw, '[^\x20\x09-\x0D]')),
n as (select rid, host, body, raw, trim(regexp_replace(low, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) as line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as words from l),
dup as (select rid, count(*) - count(distinct raw) as n from l group by rid),
hosts as (select host, count(distinct body) as docs from d group by host),
above as (select host, line from n join hosts using (host) group by host, line, docs having count(distinct body) > 20 and count(distinct body) > 0.05 * docs),
gone as (select rid, count(*) as lines, sum(words) as words from n join above using (host, line) group by rid),
m as (select rid, doc_id, len(ws) as n_words, len(array_to_string(ws, '')) as word_chars,
        len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
        coalesce(gone.lines, 0) as n_removed_lines, coalesce(gone.words, 0)::bigint as n_removed_words
      from d join w using (rid) left join rep using (rid) left join dup using (rid) left join gone using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words,
  not base_failed and n_removed_words <= 0.7 * n_words as kept from b
"""
