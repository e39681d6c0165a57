"""Similar items and nearest references against all pairs."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from evidence.operators import pairs as P


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def brute_top(rows, k, penalty=0.1):
    out = []
    for block, item, v, year in rows:
        if block is None or item is None:
            continue
        found = []
        for b2, other, w, y2 in rows:
            if b2 == block and other is not None and other != item:
                s = sum(((x or 0.0) * (y or 0.0) for x, y in zip(v or [], w or [], strict=False)), 0.0)
                conflict = year is not None and y2 is not None and year != y2
                found.append((-(max(0.0, s - penalty) if conflict else s), other, conflict))
        out += [(block, item, other, round(-s, 9), conflict, rank + 1) for rank, (s, other, conflict) in enumerate(sorted(found)[:k])]
    return out


def test_topk_similar_in_chunks(spark):
    r = random.Random(3)
    base = [unit([r.gauss(0, 1) for _ in range(6)]) for _ in range(40)]
    rows = [(f"b{r.randint(0, 2)}", i, r.choice(base), r.choice((None, 2020, 2021))) for i in range(150)]
    rows += [("b0", 1000, None, 2020), ("b0", 1001, [0.0] * 6, None), ("b0", 1002, [1.0], None), ("b1", 1003, [None, 1.0, 0.0, 0.0, 0.0, 0.0], 2020), (None, 1004, base[0], None), ("b1", None, base[0], None), ("alone", 1005, base[0], 1)]
    df = spark.createDataFrame(rows, "block string, item long, v array<double>, year int")
    for chunk in (8, 1000):
        got = P.topk_similar(df, "block", "item", "v", "year", k=4, chunk=chunk)
        found = sorted((x["block"], x["item"], x["other"], round(x["score"], 9), x["conflict"], x["rank"]) for x in got.collect())
        assert found == sorted(brute_top(rows, 4))
    named = df.select("block", F.concat(F.lit("i"), F.lpad(F.col("item").cast("string"), 5, "0")).alias("item"), "v", "year")
    by_name = {(x["item"], x["rank"]): x["other"] for x in P.topk_similar(named, "block", "item", "v", "year", k=4, chunk=8).collect()}
    assert by_name == {(f"i{x[1]:05}", x[5]): f"i{x[2]:05}" for x in brute_top(rows, 4)}
    assert P.topk_similar(df.limit(0), "block", "item", "v", "year").count() == 0


def test_each_chunk_is_shipped_once_a_pair(spark):
    df = spark.range(64).select(F.lit("b").alias("block"), F.col("id").alias("item"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"), F.lit(None).cast("int").alias("year"))
    chunks = P.packed_chunks(df, "block", "item", "v", "year", 16).collect()
    assert len(chunks) <= 4 and sum(len(c["items"]) for c in chunks) == 64 and all(len(c["numbers"]) == 2 * len(c["items"]) for c in chunks)


def brute_nearest(turns, refs, n):
    best = {}
    for label, length, seq, v in turns:
        if label not in best or (length, -seq) > (best[label][0], -best[label][1]):
            best[label] = (length, seq, v)

    def cosine(a, b):
        a, b = unit(a), unit(b)
        return sum(x * y for x, y in zip(a, b, strict=True))

    out = []
    for label, (length, _, v) in best.items():
        if length >= 1:
            out += [(label, ref, k + 1) for k, (_, ref) in enumerate(sorted((-round(cosine(v, w), 12), ref) for ref, w in refs)[:n])]
    return sorted(out)


def test_nearest_reference_prunes_nothing_near(spark):
    r = random.Random(8)
    for spread, zeros in ((0.1, False), (3.0, True)):
        centres = [[r.gauss(0, 1) for _ in range(5)] for _ in range(12)]
        near = lambda: [x + r.gauss(0, spread) for x in r.choice(centres)]  # noqa: E731, B023
        refs = [(i, near()) for i in range(300)] + ([(300, [0.0] * 5), (-1, [0.0] * 5)] if zeros else [])
        turns = [(f"l{i % 40}", r.choice((0.5, 2.0, 30.0)), i, near()) for i in range(90)] + ([("zero", 5.0, 99, [0.0] * 5)] if zeros else [])
        got = P.nearest_reference(
            spark.createDataFrame(turns, "label string, len double, seq int, v array<double>"), spark.createDataFrame(refs, "ref int, v array<double>"), "label", "len", "seq", "v", "ref"
        )
        assert sorted((x["label"], x["ref"], x["rank"]) for x in got.collect()) == brute_nearest(turns, refs, 3)
    few = P.nearest_reference(spark.createDataFrame(turns, "label string, len double, seq int, v array<double>"), spark.createDataFrame(refs[:2], "ref int, v array<double>"), "label", "len", "seq", "v", "ref")
    assert sorted((x["label"], x["ref"], x["rank"]) for x in few.collect()) == brute_nearest(turns, refs[:2], 3)


def test_recall_counts_leaks(spark):
    found = spark.createDataFrame([(1, 2, "a"), (1, 3, "a"), (4, 5, "b")], "item int, other int, block string")
    blocks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")], "item int, block string")
    expected = spark.createDataFrame([(1, 2), (4, 9)], "item int, expected int")
    row = P.recall_at_k(found, expected, "item", "block", blocks).first()
    assert (row["queries"], row["hits"], row["leaks"], row["recall"]) == (2, 1, 1, 0.5)


def test_balanced_sample_of_more_rows_than_a_sample_of_ranges_holds(spark):
    rows = spark.range(100000).select("id", (F.col("id") % 4 == 0).alias("yes"), F.concat(F.lit("name "), "id").alias("name"))
    got = [r["id"] for r in P.balanced_sample(rows, F.col("yes"), F.col("id")).collect()]
    order = sorted((i for i in range(100000) if i % 4), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    assert sorted(got) == sorted([*range(0, 100000, 4), *order[:50000]])


def test_no_copies_of_chunks_are_shuffled(spark):
    df = spark.createDataFrame([(1, 10, [1.0, 0.0], None), (1, 11, [0.6, 0.8], 2020)], "block int, item long, v array<float>, year int")
    out = P.topk_similar(df, "block", "item", "v", "year")
    assert sorted((r["item"], r["other"], round(r["score"], 6)) for r in out.collect()) == [(10, 11, 0.6), (11, 10, 0.6)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan
