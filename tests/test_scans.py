"""Blocks of intervals and scans in chunks against plain versions, and how they spread."""

import datetime
import hashlib
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidence.operators import intervals as B
from evidence.operators import temporal as T
from evidence.operators.scans import first_after, last_before


def test_blocks_hold_exactly_their_interval(spark):
    r = random.Random(2)
    pairs = [(a, a + r.choice((0, 1, 7, 8, 63, 400, 5000, -1))) for a in (r.randint(-3000, 3000) for _ in range(300))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    cut = {x["i"]: x["c"] for x in df.select("i", B.cut(F.col("a"), F.col("b"), 4).alias("c")).collect()}
    asked = {x["a"]: set(x["h"]) for x in spark.range(-3600, 8300).select(F.col("id").alias("a"), B.holders(F.col("id"), 4).alias("h")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert len(cut[i]) == len(set(cut[i]))
        found = {x for x, names in asked.items() if names & set(cut[i])}
        assert found == set(range(a, b + 1)), (a, b)
        assert all(len(names & set(cut[i])) == (a <= x <= b) for x, names in asked.items())


def test_long_intervals_cost_few_rows(spark):
    rows = [(datetime.date(2010, 3, 5), datetime.date(2020, 3, 4)), (datetime.date(2010, 3, 5), None), (None, None), (datetime.date(2020, 1, 2), datetime.date(2020, 1, 1))]
    n = [x[0] for x in spark.createDataFrame(rows, "a date, b date").select(F.size(B.days(F.col("a"), F.col("b")))).collect()]
    assert n[0] <= 25 and n[1] <= 45 and n[2] == 3 and n[3] <= 1


def test_intervals_against_all_pairs(spark):
    r = random.Random(4)
    day = lambda: datetime.date(2015, 1, 1) + datetime.timedelta(days=r.randint(0, 3000))
    iv = [(r.randint(0, 3), k, f"v{k}", *sorted((day(), day()))) for k in range(60)]
    iv += [(1, 61, "v61", None, datetime.date(2016, 1, 1)), (2, 62, "v62", datetime.date(2022, 1, 1), None), (3, 63, "v63", None, None)]
    probes = [(r.choice((0, 1, 2, 3, 4, None)), day() if k % 9 else None) for k in range(200)]
    got = T.interval_at(spark.createDataFrame(probes, "p int, d date"), spark.createDataFrame(iv, "p int, seq int, v string, since date, until date"), "p", "d", "v", "seq")
    holds = lambda p, d: [i for i in iv if i[0] == p and d is not None and (i[3] is None or i[3] <= d) and (i[4] is None or d <= i[4])]
    want = [(p, d, min(holds(p, d), key=lambda i: i[1])[2] if holds(p, d) else None) for p, d in probes]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def rows(spark):
    r = random.Random(9)
    out = [(r.choice(("hot", "hot", "hot", "a", None)), r.randint(-500, 900), i, r.choice((None, None, i))) for i in range(1500)]
    return spark.createDataFrame([*out, ("hot", None, 1500, 7), ("b", None, 1501, None)], "k string, t int, i int, v int")


def test_scans_equal_plain_windows(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("t", "i")
    for width in (1, 50, 10_000):
        for own in (True, False):
            got = last_before(df, ["k"], ["t", "i"], F.col("v"), "x", own, width).select("i", "x")
            want = df.select("i", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)).alias("x"))
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
            got = first_after(df, ["k"], ["t", "i"], F.col("v"), "x", own, width).select("i", "x")
            want = df.select("i", F.first("v", ignorenulls=True).over(w.rowsBetween(0 if own else 1, Window.unboundedFollowing)).alias("x"))
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_one_long_history_is_spread(spark):
    """The rows of one key are scanned in several tasks, where Spark does not put small partitions together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    one = spark.range(400_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    got = last_before(one, ["k"], ["t"], F.col("v"), "x").withColumn("task", F.spark_partition_id())
    found = got.agg(F.count_if(F.col("x") == F.col("t") - F.col("t") % 1000).alias("right"), F.count_distinct("task").alias("tasks")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found["right"] == 400_000 and found["tasks"] >= 3


def test_quotes_over_borders(spark):
    from evidence.operators.rows import locate_in_segments

    r = random.Random(12)
    said = {g: ["".join(r.choice("ab ") for _ in range(r.choice((0, 1, 3, 30)))) for _ in range(60)] for g in ("g", "h")}
    segments = [(g, i, x) for g, xs in said.items() for i, x in enumerate(xs)] + [("g", 100, None), ("h", 101, None), (None, 0, "ab")]
    quotes = [(g, " ".join(said[g])[a : a + n]) for g in said for a, n in ((r.randint(0, 500), r.choice((1, 2, 5, 15, 16, 17, 40, 90))) for _ in range(80))]
    quotes += [("g", "zz"), ("g", None), ("g", ""), ("none", "a")]
    got = locate_in_segments(spark.createDataFrame(segments, "g string, i int, t string"), spark.createDataFrame(quotes, "g string, q string"), "g", "i", "t", "q")
    want = set()
    for g, q in quotes:
        whole = " ".join(said.get(g, []))
        if q and q in whole:
            ends, at = [], 0
            for x in said[g]:
                ends.append(at)
                at += len(x) + 1
            want.add((g, q, max(i for i, a in enumerate(ends) if a <= whole.index(q))))
    assert {(x["g"], x["q"], x["i"]) for x in got.collect()} == want and len(want) > 60


def test_automaton_finds_the_longest_run():
    from evidence.operators.sequential import Automaton

    r = random.Random(7)
    for _ in range(400):
        a, b = ([r.choice("ab" if r.random() < 0.7 else "abcd") for _ in range(r.randint(0, 30))] for _ in range(2))
        runs = {tuple(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        best = min(((-n, i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if tuple(a[i : i + n]) in runs), default=(0, 0))
        found = Automaton(b)
        assert found.longest(a) == (best[1], -best[0]) and len(found.size) <= max(2 * len(b), 2)


def test_places_of_more_rows_than_a_sample_holds(spark):
    from evidence.operators import indexes

    rows = spark.range(60000).select("id", F.md5(F.col("id").cast("string")).alias("o"), F.concat(F.lit("name "), "id").alias("name"))
    got = indexes.ranked(rows, ["id", "name", "o"], [F.asc("o")]).drop("o").orderBy("place").collect()
    order = sorted(range(60000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [r["id"] for r in got] == order and [r["place"] for r in got] == list(range(1, 60001))


def test_quotes_in_one_row_and_by_pieces_agree(spark):
    from evidence.operators.rows import locate_in_segments

    r = random.Random(13)
    said = {g: ["".join(r.choice("ab ") for _ in range(r.choice((0, 1, 3, 30)))) for _ in range(n)] for g, n in (("g", 60), ("h", 9), ("one", 1))}
    segments = spark.createDataFrame([(g, i, x) for g, xs in said.items() for i, x in enumerate(xs)], "g string, i int, t string")
    quotes = [(g, " ".join(said[g])[a : a + n]) for g in said for a, n in ((r.randint(0, 300), r.choice((1, 2, 5, 15, 16, 17, 40, 90))) for _ in range(60))]
    asked = spark.createDataFrame([*quotes, ("g", "zz"), ("g", None)], "g string, q string")
    find = lambda whole: locate_in_segments(segments, asked, "g", "i", "t", "q", whole=whole)
    results = [sorted(tuple(x) for x in find(whole).collect()) for whole in (0, 200, 1 << 18)]  # all by pieces, the large group, none
    assert results[0] == results[1] == results[2] and len(results[0]) > 50
    assert "Generate" not in find(1 << 18)._jdf.queryExecution().optimizedPlan().toString()  # no row for each character
