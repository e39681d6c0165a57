"""Enrichment of leads, selections, series and payloads on small tables with awkward cases."""

import json
import math
import re

from pyspark.sql import functions as F

from evidence.functions import text as X
from evidence.operators import enrichment as R
from evidence.operators import selections as S
from evidence.operators.gates import corpus_regression
from evidence.operators.votes import vote_gold_cases
from evidence.sources import files


def test_profile_by_person_then_name(spark):
    leads = spark.createDataFrame([(1, 7, "Ann"), (2, None, " bob "), (3, 99, "Bob"), (4, 98, "Nobody"), (5, None, None), (1, 7, "Ann")], "id int, person int, name string")
    profiles = spark.createDataFrame([(7, "Zed", "u7"), (8, "BOB", "u8"), (9, "Bob", "u9"), (None, "Eve", "u0")], "person int, name string, url string")
    got = sorted(((r["id"], r["url"]) for r in R.with_profile(leads, profiles, "person", "name", ["url"]).collect()), key=str)
    assert got == [(1, "u7"), (1, "u7"), (2, "u8"), (3, "u8"), (4, None), (5, None)]


def test_month_or_the_last_one_before(spark):
    leads = spark.createDataFrame([(1, "2024-03-15"), (2, "2024-04-01"), (3, "2024-05-31"), (4, "bad"), (5, None), (6, "2023-12-31")], "id int, d string")
    macro = spark.createDataFrame([("2024-03", 3.0), ("2024-01", 1.0)], "month string, cpi double")
    at = lambda n: {r["id"]: r["cpi"] for r in R.with_month(leads, macro, "d", "month", ["cpi"], n).collect()}
    assert at(0) == {1: 3.0, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert at(1) == {1: 3.0, 2: 3.0, 3: None, 4: None, 5: None, 6: None} and at(2)[3] == 3.0


def test_articles_by_an_inverted_index(spark):
    articles = [(1, "Tax cut and tax plan"), (2, "the plan for the budget"), (3, "Budget, budget and the tax CUT"), (4, None), (5, ""), (6, "the the the")]
    asked = ["the tax cut", "budget plan", "nothing here", None, "The"]
    words = lambda x: set(re.findall(r"\w{3,}", (x or "").lower()))
    held = {a: words(x) for a, x in articles if words(x)}
    n = {w: sum(w in h for h in held.values()) for h in held.values() for w in h}
    want = {}
    for q in asked:
        mine = [w for w in words(q) if w in n]
        rare = sorted(mine, key=lambda w: (n[w], w))[:2]
        scored = [(-round(sum(math.log(len(held) / n[w]) for w in mine if w in h), 6), a) for a, h in held.items() if set(rare) & h]
        if scored:
            want[q] = [a for _, a in sorted(scored)][:3]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = R.with_articles(df, spark.createDataFrame(articles, "id int, text string"), "q", "id", "text", k=3).collect()
    assert {r["q"]: r["articles"] for r in got if r["articles"]} == want and len(got) == 5


def test_selections(spark):
    claims = spark.createDataFrame([(1, "STANCE_COMMITMENT", "OWN_STANCE", False, 1, "p"), (2, "STANCE_COMMITMENT", "OWN_STANCE", True, 1, "p"), (3, "STANCE_COMMITMENT", "QUOTED", None, 1, "p"), (4, "STANCE_COMMITMENT", "OWN_STANCE", None, None, "p"), (5, "STANCE_COMMITMENT", "OWN_STANCE", None, 1, ""), (6, None, "OWN_STANCE", None, 1, "p")], "id int, c string, a string, chair boolean, turn int, who string")
    assert [r["id"] for r in S.own_commitments(claims, F.col("c"), F.col("a"), F.col("chair"), "turn", F.col("who")).collect()] == [1]
    rows = spark.createDataFrame([(1, '{"x": 5}', 1, 1, "t"), (2, "broken", 1, 1, None), (3, '{"x": 6}', 1, 0, "t"), (4, "{}", None, 1, "t")], "id int, j string, v int, ok int, at string")
    got = {r["id"]: r["record"].asDict() for r in S.verified_records(rows, "j", "x int", "v", "ok", "at").collect()}
    assert got == {1: {"x": 5, "approvedAt": "t"}, 2: {"x": None, "approvedAt": None}} and S.verified_records(rows, "j", "x int", "v").count() == 3
    owners = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert [r["id"] for r in S.by_owner(rows, "id", owners).collect()] == [1]
    turns = spark.createDataFrame([(1, "b"), (1, "a"), (7, "c")], "id int, turn string")
    assert [(r["id"], r["turn"]) for r in S.turn_lookup(rows.select("id"), turns, "id", ["turn"]).collect()] == [(1, "a")]
    events = spark.createDataFrame([("k", 5000 - i, i) for i in range(300)] + [("k", None, 999), (None, 1, 1)], "k string, t int, i int")
    places = {(r["k"], r["i"]): r["pos"] for r in S.timeline(events, "k", ["t", "i"], width=7).collect()}
    assert places[("k", 999)] == 1 and all(places[("k", i)] == 301 - i for i in range(300)) and places[(None, 1)] == 1
    assert spark.range(1).select(S.without(F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("x")), "x").alias("v")).first()["v"] == ["a", "b"]
    union = S.concat_sources({"a": spark.range(1), "b": spark.createDataFrame([(2, "t")], "id long, text string")})
    assert sorted((r["id"], r["text"], r["origin"]) for r in union.collect() if r["id"]) == [(2, "t", "b")] and union.count() == 2


def test_roles_and_payloads(spark):
    titles = [("Předseda PSP Jan Novák", "Jan Novák"), ("Jan Novák", "Jan Novák"), (" Poslanec  Jan Novák x", "Jan Novák"), ("Ministr", ""), (None, "x")]
    got = spark.createDataFrame(titles, "t string, s string").select(X.role_of(F.col("t"), F.col("s")).alias("r")).withColumn("chair", X.is_chair(F.col("r"))).collect()
    assert [(r["r"], r["chair"]) for r in got] == [("Předseda PSP", True), ("Jan Novák", False), ("Poslanec", False), ("Ministr", False), (None, False)]
    df = spark.createDataFrame([(1, 'say "hi"\n\\ ž' * 3, None, ""), (None, None, "en", "x")], "id int, text string, lang string, note string")
    out = [json.loads(r[0], object_pairs_hook=list) for r in df.select(X.payload_json({"b": F.col("id"), "a": F.col("text")}, {"lang": F.col("lang"), "note": F.col("note")}, most=8)).collect()]
    assert out == [[("b", "1"), ("a", 'say "hi"')], [("b", None), ("a", None), ("lang", "en"), ("note", "x")]] or out == [[("b", 1), ("a", 'say "hi"')], [("b", None), ("a", None), ("lang", "en"), ("note", "x")]]


def test_rates_and_tables(spark):
    records = ['{"date": "05.01.2024", "2T repo": 6.75}', '{"datum": "2024-01-20", "date": "", "repo": "6,5"}', '{"date": "2024-02-01", "repo": 0, "rate": 1.257}', '{"date": "2024-03-01", "repo": null}', "[1]", "broken", None, '{"repo": 3}', '{"date": "2024-04-01", "rate": "x"}']
    got = files.rate_series(spark.createDataFrame(list(enumerate(records)), "seq int, r string"), "r", "seq").collect()
    assert sorted((r["month"], r["value"]) for r in got) == [("2024-01", 6.5), ("2024-02", 1.26)]
    lines = ["Datum|1 EUR| 100 HUF |", "02.01.2024|24,5|6,1|", "2024-01-03|24.7||9", "x|1|2", "05.02.2024|25,0|bad"]
    table = files.piped_series(spark.createDataFrame(list(enumerate(lines)), "seq int, line string"), "line", "seq").collect()
    assert sorted((r["month"], r["name"], r["value"]) for r in table) == [("2024-01", "1 EUR", 24.6), ("2024-01", "100 HUF", 6.1), ("2024-02", "1 EUR", 25.0)]


def test_regression_and_gold_cases(spark):
    rows = spark.createDataFrame([("a", i, "t" if i else "") for i in range(100)] + [("b", 200, "t")], "g string, n int, text string")
    got = {r["g"]: r for r in corpus_regression(rows, "g", {"too large": F.col("n") > 150}, F.col("n") == 200, F.col("text") == "").collect()}
    assert (got["a"]["failing"], got["a"]["lost"], got["a"]["alarm"], got["a"]["failed"]) == (0, 1, True, True)
    assert (got["b"]["failing"], got["b"]["found"], got["b"]["alarm"], got["b"]["failed"]) == (1, 1, False, True)
    messages = spark.createDataFrame([(1, 10, "PRO"), (1, 10, "PRO"), (1, 11, None), (2, 99, "PRO")], "m int, ballot int, said string")
    ballots = spark.createDataFrame([(10, "PROTI", "SUBSTANTIVE"), (11, "PRO", "PROCEDURAL")], "ballot int, did string, k string")
    cases = vote_gold_cases(messages, ballots, ["m"], "ballot", F.col("said"), F.col("did"), F.col("k")).collect()
    assert sorted((r["m"], r["ballot"], r["said"], r["did"]) for r in cases) == [(1, 10, "PRO", "PROTI"), (1, 11, None, "PRO")] and all(r["reason"] for r in cases)
