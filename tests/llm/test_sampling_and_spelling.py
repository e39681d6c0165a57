"""Resampling, mixing and spelling variants against brute force, with awkward cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from evidence.llm import mixing, queries, resampling, spelling
from tests.sqlcheck import connect, differences

TEXTS = [
    None, "", " \n", "one two  three", "A-b C_d éÉ ÀB ×y÷z", "same words " * 12, "same words " * 12, "x" * 5000, "Straße groß naïve ÿ 12 kinds " * 9,
    "the colour of the color and colours " * 8,
]


def make_docs(spark, more=60):
    r = random.Random(3)
    names = ["colour", "color", "colours", "honour", "honor", "theatre", "theater", "centre", "center", "analyse", "analyze", "été", "étés", "naïveté"]
    texts = TEXTS + [" ".join(r.choice(names) for _ in range(r.randint(1, 60))) for _ in range(more)]
    sources = ["b", "a", None, "ü", "Z", ""]
    rows = [(i, t, sources[i * i % 7 % 6] if i > 3 else "A", 1, 2, 3, "k") for i, t in enumerate(texts)] + [(7, "x" * 5000, None, 1, 2, 3, "k"), (None, "words of no document " * 6, "a", 1, 2, 3, "k")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n long, rank long, size long, key string")


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def text_features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    rows, docs = make_docs(spark)
    target = ["The colour of honour", None, "ÉTÉ naïve"]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own = [text_features(t, longest) for _, t, *_ in rows]
    s = collections.Counter(bucket(f) for _, fs in own for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in text_features(x, longest)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    want = []
    for (i, *_), (words, fs) in zip(rows, own, strict=True):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], math.inf if w[0] is None else w[0]))
    ranks = [(*w[:4], k + 1 if k < len(able) * 10 // 100 else None) for k, w in enumerate(able)] + [(*w[:4], None) for w in want if not w[4]]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ranks, key=str)
    assert len(able) >= 30


def test_resampling_in_blocks(spark):
    text = " ".join(f"w{k}é--" for k in range(400))
    assert len(list(resampling.blocks(text, 9))) > 100 and "".join(resampling.blocks(text, 9)) == text
    split = resampling.word_splitter()
    assert [w for b in resampling.blocks(text, 9) for w, _ in split(b)] == [w for w, _ in split(text)] == text_features(text, 1)[0]
    _, docs = make_docs(spark)
    for longest in (1, 3):
        whole, cut = (resampling.features(docs, longest, 997, **more).collect() for more in ({}, {"block": 7}))
        for a, b in zip(whole, cut, strict=True):
            assert (a["doc_id"], a["n_words"], sorted(memoryview(a["cells"]).cast("H"))) == (b["doc_id"], b["n_words"], sorted(memoryview(b["cells"]).cast("H")))


def test_resampling_empty(spark):
    _, docs = make_docs(spark)
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert resampling.resample(docs, none).where("rank is not null").count() > 0


def filled(sizes, weights, most=3.0):
    """Targets by resharing one excess after the other."""
    total, bounded = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in bounded]
        level = (total - sum(most * sizes[k] for k in bounded)) / (sum(weights[k] for k in free) or 1)
        above = {k for k in free if weights[k] * level > most * sizes[k]}
        if not above:
            return [most * sizes[k] if k in bounded else weights[k] * level for k in range(len(sizes))]
        bounded |= above


def test_mixing(spark):
    rows, docs = make_docs(spark)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    by = {n: sum(z for z, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    target = dict(zip(names, filled([by[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    want = []
    for (i, _, n, *_), z in zip(rows, size, strict=True):
        rate = min(3.0, target[n] / by[n]) if by[n] else 0.0
        h = int(hashlib.sha256(f"12:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        want.append((i, z, by[n], round(target[n], 6), z * (int(rate) + (h < rate - int(rate)))))
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mixed(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(target[n] == 3 * by[n] for n in names) and abs(sum(target.values()) - sum(size)) < 1e-6
    out = mixing.mix(docs)
    assert set(out.columns) == {*docs.columns, "copy"}
    assert out.select("text").where("text is not null").rdd.map(lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[0]))).sum() == sum(w[4] for w in want)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.where("text is null")).collect()[0]["target"] == 0.0


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 40), "abc"[0 if i % 3 else r.randint(1, 2)]) for i in range(9000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 3 and all(abs(x["sum(taken)"] / x["max(target)"] - 1) < 0.05 for x in got)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, counts[w], len(near[w]), form[w], form[w] and counts[form[w]], root(w)) for w in counts), key=str)


def test_spelling(spark):
    rows, docs = make_docs(spark, 400)
    counts = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = sorted(((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(docs).collect()), key=str)
    assert got == brute_variants(counts) and any(r[3] for r in got)
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghij"])
def test_near_pairs_are_all_found(spark, letters):
    """Few letters make hot bigrams, repeated bigrams and equal ranks."""
    r = random.Random(letters)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(700)})
    counts = collections.Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(x["word"], x["near"]) for x in spelling.near_pairs(spelling.signatures(df, counts)).collect()}
    assert got == {p for p in itertools.permutations(words, 2) if one_edit(*p)}


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(1)
    for _ in range(300):
        places = [(i, r.randint(1, 9)) for i in sorted(r.sample(range(12), r.randint(3, 8)))]
        cost = dict(places)
        a, b = spelling.pivots(places)
        assert b - a >= 2 and cost[a] + cost[b] == min(x[1] + y[1] for x, y in itertools.combinations(places, 2) if y[0] - x[0] >= 2)


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    counts = {"ab": 1, "bc": 2, "cd": 3, "de": 4}
    spark.createDataFrame([("abcde", 3)], "word string, n long").write.parquet(str(tmp_path / "words"))
    near = spelling.near_pairs(spelling.signatures(spark.read.parquet(str(tmp_path / "words")), counts))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_chains_end_at_their_root(spark):
    from evidence.llm.common import Scratch

    df = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)] + [("a", "b")], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(df, Scratch(spark, "roots")).collect()}
    assert got == {**{f"w{k}": "w40" for k in range(40)}, "a": "b"}


@pytest.mark.parametrize("name", ["op11_resampling", "op12_mixing", "op13_spelling"])
def test_matches_sql(spark, data, name):
    spark_only, sql_only = differences(queries.QUERIES[name](spark, data), connect(data), queries.ORACLE_SQL[name])
    assert not spark_only and not sql_only, (list(spark_only)[:2], list(sql_only)[:2])
