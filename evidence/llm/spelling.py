"""Spelling variants: words at one edit from each other, found by pivotal bigrams, and the form each goes back to.

Words are counted by Spark's own functions. Of each word of the vocabulary the rarest bigrams are its prefix, and two
disjoint ones of them its pivots. If two words are one edit apart, that edit leaves at least one pivot of the word with the
smaller prefix whole, and this bigram is in the other word's prefix; all letters before it or all after it
are then the same as well, which is the position limit that the join uses, with one letter of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """All runs of letters, A-Z in lower case, as `word`; one in `one_in` by a hash of document and run loses a letter."""
    run = F.col("run")
    low = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    low = low.select("doc_id", F.when(F.lower(run) == run, run).otherwise(F.translate(run, _UPPER, _UPPER.lower())).alias("run"))
    hashed = low.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return hashed.select(F.when(F.pmod(F.col("h"), F.lit(one_in)) == 0, cut).otherwise(run).alias("word"))


def vocabulary(docs: DataFrame, one_in: int = 97, letters: int = 5, least: int = 3) -> DataFrame:
    """word and n of the words with at least `letters` code points and `least` occurrences; partial counts are shuffled."""
    found = runs(docs, one_in).where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def pivots(places: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of two disjoint bigrams of least total count; places are (position, count) by position.

    best[i] is the cheapest bigram among the first i; a pair ends at a bigram and takes the cheapest that ends before it.
    """
    best: list[tuple[int, int]] = []
    chosen = None
    behind = 0
    for at, count in places:
        while behind < len(places) and places[behind][0] + 2 <= at:
            one = (places[behind][1], places[behind][0])
            best.append(min(best[-1], one) if best else one)
            behind += 1
        if behind:
            pair = (count + best[behind - 1][0], best[behind - 1][1], at)
            chosen = pair if chosen is None else min(chosen, pair)
    return chosen[1], chosen[2]


def signatures(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """word, n, last (rank of its prefix's most frequent bigram), prefix and pivots (positions of bigrams, from 0).

    The prefix is the three rarest bigrams, with all places of the last of them that the word has.
    """
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, prefix, pivot = [], [], []
            for w in batch.column(0).to_pylist():
                grams = sorted((rank[w[i : i + 2]], i) for i in range(len(w) - 1))
                top = grams[2][0]
                own = sorted(i for r, i in grams if r <= top)
                last.append(top)
                prefix.append(own)
                pivot.append(pivots([(i, counts[w[i : i + 2]]) for i in own]))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(last, pa.int32()), pa.array(prefix, kind), pa.array(pivot, kind)], names=["word", "n", "last", "prefix", "pivots"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, last int, prefix array<int>, pivots array<int>")


def _keys(signed: DataFrame, places: str) -> DataFrame:
    """A row for each named bigram, side and key: hashes of the bigram with all letters before it, or all after it, and one letter of the rest.

    One edit of the rest leaves its letter next to the bigram or its letter at the word's other end; only a rest of at most one letter may lose both.
    """
    at, size = F.col("at"), F.length("word")
    head, tail = F.substr("word", F.lit(1), at + 2), F.substr("word", at + 1)
    key = lambda mark, *parts: F.xxhash64(F.lit(mark), *parts)
    keys = F.array(
        F.when(size > at + 2, key("head next", F.substr("word", F.lit(1), at + 3))), F.when(size > at + 2, key("head end", head, F.substring("word", -1, 1))), F.when(size <= at + 3, key("head", head)),
        F.when(at > 0, key("tail next", F.substr("word", at))), F.when(at > 0, key("tail end", tail, F.substring("word", 1, 1))), F.when(at <= 1, key("tail", tail)),
    )
    return signed.select("word", "n", "last", F.explode(places).alias("at")).select("word", "n", "last", F.explode(F.array_compact(keys)).alias("key"))


def near_pairs(signed: DataFrame) -> DataFrame:
    """word, n, near and near_n for words one edit apart, in both directions; a pair may occur several times.

    Both sides are exploded to some ten rows a word, which Spark's estimate leaves out, so it would send one of them whole through the driver.
    """
    index = _keys(signed, "prefix")
    asked = _keys(signed, "pivots").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("near_last"))
    apart = F.abs(F.length("word") - F.length("near")) <= 1
    found = index.join(asked.hint("merge"), "key").where((F.col("last") >= F.col("near_last")) & (F.col("word") != F.col("near")) & apart & (F.levenshtein("word", "near", 1) == 1))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return found.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root for rows of (word, form): forms followed to the last, twice as far in each round.

    A form is at least twice as frequent as its word, so a chain has at most 62 steps and there are at most six rounds that change a row.
    """
    cur = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.save(cur.join(nxt.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        scratch.drop(cur)
        cur = new
        if not moved:
            return cur.select("word", "root")


def variants(docs: DataFrame, one_in: int = 97, letters: int = 5, least: int = 3) -> DataFrame:
    """One row a word: word, n, n_near, form, form_n and root.

    docs needs doc_id and text. Words are runs of letters with A-Z in lower case, of which one in `one_in` by a hash lost a
    letter. Two words are near at exactly one inserted, deleted or replaced code point. A word's form is its near word with the largest n
    (ties: the smallest by code point) if that is at least twice its own n; its root is where the forms end.

    Null, empty or letterless text gives no words; a null doc_id is hashed as an empty one; repeated rows count again; an empty table
    gives an empty one. `letters` must be four or more, so that a word has three bigrams. Other columns are not read. Only the counts of bigrams come to the driver: the alphabet has 90 letters,
    so there are at most 8100.
    """
    if letters < 4:
        raise ValueError("words need at least four letters")
    s = Scratch(docs.sparkSession, "spelling")
    words = s.save(vocabulary(docs, one_in, letters, least))
    gram = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    counts = {r["gram"]: r["count"] for r in words.select(F.explode(gram).alias("gram")).groupBy("gram").count().collect()}
    near = near_pairs(s.save(signatures(words, counts)))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    grouped = s.save(near.groupBy("word", "n").agg(F.count_distinct("near").alias("n_near"), best.alias("best")))
    better = -F.col("best.order") >= 2 * F.col("n")
    told = grouped.select("word", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.order")).alias("form_n"))
    ends = roots(told.where(F.col("form").isNotNull()), s)
    out = words.join(told.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")  # files are smaller than the rows in them
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _sql() -> str:
    from .resampling import CRC_SQL

    return rf"""
with recursive low as (select doc_id, translate(text, '{_UPPER}', '{_UPPER.lower()}') as text from documents),
run as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from low) group by 1, 2),
strings as (select distinct doc_id || ':' || run as w from run),
{CRC_SQL},
cut as (select c, case when crc % 97 = 0 then left(run, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word from run join crc on w = doc_id || ':' || run),
v as (select word, sum(c)::bigint as n from cut where length(word) >= 5 group by word having sum(c) >= 3),
del as (select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from v)),
near as (select distinct * from (
  select a.word, a.n, b.word as near, b.n as near_n from del a join del b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union all select a.word, a.n, v.word, v.n from del a join v on a.rest = v.word
  union all select v.word, v.n, a.word, a.n from del a join v on a.rest = v.word)),
best as (select word, n, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word, n),
form as (select word, n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n from best),
chain as (select word, word as form, 0 as step from v union all select chain.word, form.form, step + 1 from chain join form on form.word = chain.form where form.form is not null),
ends as (select word, arg_max(form, step) as root from chain group by word)
select v.word, n, coalesce(n_near, 0) as n_near, form, form_n, root from v left join form using (word) join ends using (word)
"""


SQL = _sql()
