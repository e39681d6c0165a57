"""Stated results on small hand-made tables: ties, nulls, inclusive ends and tampered rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidence.functions import rules as R
from evidence.functions import score as S
from evidence.functions import text as X
from evidence.operators import gates as G
from evidence.operators import incremental as N
from evidence.operators import indexes as I
from evidence.operators import pairs as P
from evidence.operators import sequential as Q
from evidence.operators import temporal as T
from evidence.operators import votes as V
from evidence.sources import files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def d(text):
    return dt.date.fromisoformat(text)


def test_nearest_occurrence(spark):
    text, snippet = F.lit("ab cd ef ab cd ef ab cd"), F.lit("ab")
    assert one(spark, X.nearest_occurrence(text, snippet, F.lit(9))) == 9
    assert one(spark, X.nearest_occurrence(text, snippet, F.lit(None).cast("int"))) == 0
    assert one(spark, X.nearest_occurrence(text, F.lit(""), F.lit(3))) is None
    assert one(spark, X.nearest_occurrence(text, F.lit("zz"), F.lit(3))) is None
    assert one(spark, X.nearest_occurrence(F.lit("aaaa"), F.lit("aa"), F.lit(1))) == 1


@pytest.mark.parametrize("score, tier", [(0.97, "PUBLISHED"), (0.95, "PUBLISHED"), (0.85, "CONTEXT_DEVELOPMENT"), (0.80, "CONTEXT_DEVELOPMENT"), (0.70, "DROPPED"), (None, "DROPPED")])
def test_tier(spark, score, tier):
    assert one(spark, S.presentation_tier(F.lit(score).cast("double"))) == tier


def test_composite_score(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.composite_score(S.WEIGHTS, nli=none, similarity=none, hard_fact=none, tribunal=none)) == pytest.approx(0.5)
    assert one(spark, S.composite_score(S.WEIGHTS, nli=F.lit(1.0), similarity=F.lit(1.0), hard_fact=F.lit(True), tribunal=F.lit(1.0))) >= 0.95
    assert one(spark, S.composite_score(S.WEIGHTS, nli=F.lit(0.98), similarity=F.lit(0.85), hard_fact=F.lit(True), tribunal=F.lit(0.98))) >= 0.95


@pytest.mark.parametrize("n, high, index", [(0, 0, 1.0), (10, 0, 1.0), (10, 2, 0.8), (1, 5, 0.0)])
def test_consistency_index(spark, n, high, index):
    assert one(spark, S.consistency_index(F.lit(n), F.lit(high))) == index


def test_speech_metrics(spark):
    rows = [("a", x) for x in (50, 100, 300, 500, 900)] + [("b", x) for x in range(100, 700, 100)] + [("c", 10)] * 4
    out = {r["who"]: (r["n"], r["median"], r["short_share"]) for r in I.speech_metrics(spark.createDataFrame(rows, "who string, n_chars int"), "who", "n_chars").collect()}
    assert out == {"a": (5, 300.0, 0.4), "b": (6, 350.0, round(1 / 6, 4))}


@pytest.mark.parametrize("stance, vote, result", [("PRO", "PRO", "SHODA"), ("PROTI", "PROTI", "SHODA"), ("PRO", "PROTI", "NESHODA"), ("PROTI", "PRO", "NESHODA"), ("PRO", "JINAK", "NEHLASOVAL"), ("PRO", None, "NEHLASOVAL")])
def test_agreement(spark, stance, vote, result):
    assert one(spark, V.agreement(F.lit(stance), F.lit(vote).cast("string"))) == result


def test_fixed_group_without_votes_is_null(spark):
    votes = spark.createDataFrame([(1, "A", "x"), (1, "Z", "x")], "ballot int, code string, club string")
    out = V.single_group_tally(votes, spark.createDataFrame([(1,)], "ballot int"), "ballot", "club", "code", ["x", "y"], {"pro": "A", "absent": "-"}, "absent")
    assert {(r["club"], r["pro"], r["absent"]) for r in out.collect()} == {("x", 1, 1), ("y", None, None)}


def test_last_final_vote_and_second_session(spark):
    finals = spark.createDataFrame([(7, 10, 100), (7, 14, 140)], "bill int, session int, ballot int")
    claims = spark.createDataFrame([(1, 7, 10), (2, 7, 14), (3, 7, 99)], "claim int, bill int, session int")
    first = {r["claim"]: r["ballot"] for r in V.final_votes(claims, finals, "bill", "session", "ballot", ["ballot"]).collect()}
    last = {r["claim"]: r["ballot"] for r in V.final_votes(claims, finals, "bill", "session", "ballot", ["ballot"], last=True).collect()}
    assert first == {1: 100, 2: 140, 3: 100}  # a claim of a second session keeps its own ballot
    assert last == {1: 100, 2: 140, 3: 140}


def test_interval_ends_and_ties(spark):
    iv = spark.createDataFrame(
        [(1, 1, "first", d("2020-01-01"), d("2020-01-31")), (1, 2, "second", d("2020-01-31"), None), (1, 0, "open", None, d("2019-01-01"))],
        "person int, seq int, club string, since date, until date",
    )
    probes = spark.createDataFrame([(1, d(x)) for x in ("2018-05-05", "2019-06-01", "2020-01-31", "2020-02-01")] + [(2, d("2020-01-31"))], "person int, d date")
    out = {(r["person"], str(r["d"])): r["club"] for r in T.interval_at(probes, iv, "person", "d", "club", "seq").collect()}
    assert out == {(1, "2018-05-05"): "open", (1, "2019-06-01"): None, (1, "2020-01-31"): "first", (1, "2020-02-01"): "second", (2, "2020-01-31"): None}
    latest = {(r["person"], str(r["d"])): r["club"] for r in T.fact_at(probes, iv, "person", "d", "club", "since", "until").collect()}
    assert latest[(1, "2020-01-31")] == "second" and latest[(1, "2018-05-05")] == "open"


def test_excused(spark):
    ex = spark.createDataFrame([(1, 60, 120), (2, 60, None)], "person int, f int, t int")
    ev = spark.createDataFrame([(1, 1, 60), (2, 1, 121), (3, 1, None), (4, 2, 70), (5, 3, None)], "id int, person int, m int")
    out = {r["id"]: r["excused"] for r in T.excused(ev, ex, "person", "m", "f", "t").collect()}
    assert out == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_context_window(spark):
    m = spark.createDataFrame([("d", 1, 860, "x"), ("d", 2, 845, "y"), ("d", 3, 960, "z"), ("d", 4, None, "n")], "debate string, id int, minute int, text string")
    out = {(r["id"], r["other"]) for r in T.context_window(m, "debate", "id", "minute", "text").collect()}
    assert out == {(1, 2), (2, 1)}


def test_point_in_turn(spark):
    turns = spark.createDataFrame([("r", 0.0, 10.0, "A"), ("r", 10.0, 20.0, "B")], "rec string, a double, b double, who string")
    points = spark.createDataFrame([("r", 1.0), ("r", 10.0), ("r", 12.0), ("r", 25.0)], "rec string, t double")
    out = {r["t"]: r["who"] for r in T.point_in_turn(points, turns, "rec", "t", "a", "b", "who").collect()}
    assert out == {1.0: "A", 10.0: "B", 12.0: "B", 25.0: None}


def test_speaker_groups(spark):
    rows = spark.createDataFrame([("A", 2.0, 4.0, "b"), ("A", 1.0, 3.0, "a"), (None, 1.0, 1.0, "x")], "who string, at double, seconds double, text string")
    out = I.speaker_groups(rows, "who", "at", "seconds", "text").collect()
    assert [(r["who"], r["seconds"], r["text"]) for r in out] == [("A", 7.0, "a b")]


def test_speaker_groups_keep_only_what_is_seen(spark):
    rows = [("a", i // 2, 1, None if i % 7 == 0 else "" if i % 5 == 0 else "xyz"[i % 3] * (i % 4)) for i in range(4000)]
    rows += [("b", i, 2, chr(98 + i) * 280) for i in range(5)] + [("c", 1, 3, None), (None, 1, 1, "q")]
    out = I.speaker_groups(spark.createDataFrame(rows, "who string, at long, seconds long, text string"), "who", "at", "seconds", "text")
    want = {}
    for who in "abc":
        mine = [r for r in rows if r[0] == who]
        want[who] = (sum(r[2] for r in mine), " ".join(r[3] for r in sorted((r for r in mine if r[3] is not None), key=lambda r: (r[1], r[3])))[:300])
    assert {r["who"]: (r["seconds"], r["text"]) for r in out.collect()} == want
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_first_kinds_are_reduced_before_they_are_collected(spark, data):
    from evidence.plans import catalog

    plan = catalog.queries()["first_k_array"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [user_id" in plan and "min(event_id" in plan[plan.index("collect_list") :]


def test_domain_tier(spark):
    lookup = spark.createDataFrame([("example.com", 1), ("blog.example.com", 4)], "domain string, tier int")
    urls = ["https://example.com/a", "http://WWW.Example.com", "https://news.example.com", "https://blog.example.com/x", "https://other.org", "not a url"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string").select("id", X.host(F.col("url")).alias("host"))
    out = {r["id"]: r["tier"] for r in X.suffix_tier(rows, "host", lookup, "domain", "tier").collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 4, 4: None, 5: None}


def test_fences_and_claims(spark):
    assert one(spark, X.strip_fences(F.lit("  ```json\n[1]\n``` "))) == "[1]" and one(spark, X.strip_fences(F.lit("```\n[1]```"))) == "[1]"
    good = '{"subject":"s","predicate":"p","object":"o","timeFrame":"t","condition":"c","claimCategory":" policy ","speechAct":"own_stance","rawSpan":"%s","extractionConfidence":0.5}'
    cases = {1: f"[{{}}, {good % 'tax'}]", 2: "not json", 3: '{"a": 1}', 4: f"[{good % 'absent'}]", 5: f"```json\n[{good % 'We'}]\n```"}
    rows = spark.createDataFrame([(k, v, "We cut tax") for k, v in cases.items()], "id int, answer string, text string")
    out = [(r["claim_id"], r["char_start"], r["char_end"], r["confidence"]) for r in X.claims_from_json(rows, "id", "answer", "text", ["POLICY"], ["OWN_STANCE"]).collect()]
    assert sorted(out) == [("1-c2", 7, 10, 0.5), ("5-c1", 0, 2, 0.5)]


def test_czech_rules(spark):
    kind = lambda x: one(spark, X.classify_ballot(F.lit(x)))
    assert kind("Pořad schůze")["kind"] == "PROCEDURAL_AGENDA" and kind("ZMĚNA POŘADU")["kind"] == "PROCEDURAL_AGENDA"
    assert kind("návrh zákona jako celek") == ("SUBSTANTIVE_FINAL", True) and kind("Pozměňovací návrh A")["substantive"]
    assert kind("cokoli") == ("PROCEDURAL_OTHER", False) and kind(None)["kind"] == "PROCEDURAL_OTHER"
    stance = lambda x: one(spark, X.verbal_commitment(F.lit("úvod " * 30 + x)))
    assert stance("PODPOŘÍME tento návrh") == "PRO" and stance("zdržíme se") == "ZDRZEL_SE" and stance("nic") is None
    assert stance("nepodpoříme to") == "PROTI"  # a pattern without its left boundary would find PRO here
    assert one(spark, X.clean_speech(F.lit("Vážená paní předsedající, děkuji za slovo. Text."))) == "Text."
    assert one(spark, S.keyword_class(F.lit("To NESOUVISÍ"), R.DISMISSALS, R.DISMISSAL_REST)) == "TOPIC_MISMATCH"


def test_topk_penalty_and_block(spark):
    rows = [(1, "p", [1.0, 0.0], 2020), (2, "p", [1.0, 0.0], 2021), (3, "p", [1.0, 0.0], 2020), (4, "q", [1.0, 0.0], 2020)]
    out = P.topk_similar(spark.createDataFrame(rows, "id int, who string, v array<double>, year int"), "who", "id", "v", "year").where("id = 1").orderBy("rank").collect()
    assert [(r["other"], round(r["score"], 6), r["conflict"], r["rank"]) for r in out] == [(3, 1.0, False, 1), (2, 0.9, True, 2)]


def test_gate_finds_tampering(spark):
    ballots, annulled = spark.createDataFrame([(1,), (2,)], "ballot int"), spark.createDataFrame([(2,)], "ballot int")
    votes = spark.createDataFrame([(1, 10, "PRO"), (1, 11, "JINAK")], "ballot int, person int, data_vote string")
    rows = [
        ("ok", 1, 10, "PRO", "PRO", "SHODA"), ("turned", 1, 10, "PRO", "PROTI", "NESHODA"), ("invented", 1, 11, "PRO", "PRO", "SHODA"), ("changed", 1, 10, "PRO", "PRO", "NESHODA"),
        ("annulled", 2, 10, "PRO", "PRO", "SHODA"), ("unknown", 9, 10, "PRO", "PRO", "SHODA"), ("nobody", 1, None, "PRO", "PRO", "SHODA"), ("absent", 1, 12, "PRO", "PRO", "SHODA"),
    ]
    stored = spark.createDataFrame(rows, "id string, ballot int, person int, stance string, vote string, agreement string")
    out = {r["id"]: r["reason"] for r in G.gate_agreement(stored, ballots, annulled, votes).collect()}
    assert out == {
        "ok": None, "turned": "direction differs", "invented": "vote without direction", "changed": "agreement differs", "annulled": "ballot annulled",
        "unknown": "ballot missing", "nobody": "no person", "absent": "no vote",
    }
    with pytest.raises(ValueError):
        G.assert_none(stored, "failed")


def test_clock_scan():
    assert Q.resolve_clock(["900", "0905", "93000", None, "x", "1430", "2015", "10"])[0] == [32400, 32700, 34200, None, None, 52200, 72900, 86410]
    assert Q.resolve_clock(["93000", "2330"])[0] == [34200, 1410]  # no step within the gap: the nearest reading
    assert Q.resolve_clock(["235000", "160000", "001000"])[0] == [85800, 57600, 87000]  # the last time never moves back
    assert Q.match_in_order(["a", "x", "c"], ["a", "b", "c"]) == [0, None, 2]


def test_ordered_scans_by_group(spark):
    """The grouped forms against the plain scans, and every way to read the result."""
    rows = [(k % 3, i, "abcab"[(i * 7 + k) % 5], f"{(i * 137 + k * 11) % 2400:04d}") for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, pos int, label string, digits string")
    right = df.where("pos % 4 <> 0").withColumn("anchor", F.col("pos"))
    out = Q.greedy_anchor_match(df, right, ["g"], "pos", "label", "anchor")
    assert out.count() == len(rows) and out.select("anchor").count() == len(rows)
    got = {(r["g"], r["pos"]): r["anchor"] for r in out.collect()}
    clocks = {(r["g"], r["pos"]): r["at"] for r in Q.ambiguous_clocks(df, ["g"], "pos", "digits").collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        other = [r for r in own if r[1] % 4]
        hits = Q.match_in_order([r[2] for r in own], [r[2] for r in other])
        assert [got[g, r[1]] for r in own] == [None if h is None else other[h][1] for h in hits]
        assert [clocks[g, r[1]] for r in own] == Q.resolve_clock([r[3] for r in own])[0]


def test_longest_run_against_all_runs():
    import random

    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        runs = [(-n, i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b)))]
        best = min(runs, default=(0, 0))
        assert Q.longest_run(a, b) == (best[1], -best[0])


def test_equal_probes_stay(spark):
    probes = spark.createDataFrame([("p", "2024-01-05")] * 2 + [(None, "2024-01-05")], "person string, d string").select("person", F.to_date("d").alias("d"))
    iv = spark.createDataFrame([("p", "A", 1, "2024-01-01", None)], "person string, club string, seq int, since string, until string").select("person", "club", "seq", F.to_date("since").alias("since"), F.to_date("until").alias("until"))
    assert [r["club"] for r in T.interval_at(probes, iv, "person", "d", "club", "seq").collect()].count("A") == 2
    assert T.interval_at(probes, iv, "person", "d", "club", "seq").count() == T.fact_at(probes, iv, "person", "d", "club", "since", "until").count() == 3
    people = spark.createDataFrame([("Ann", 1950, 7)], "name string, born int, id int")
    asked = spark.createDataFrame([("ann", 50), ("ann", 50)], "name string, year int")
    from evidence.operators import indexes

    assert [r["id"] for r in indexes.identity(asked, people, "name", "year", "born", "id").collect()] == [7, 7]


def test_nearest_occurrence_against_all(spark):
    import random

    from evidence.functions import text as X

    r = random.Random(4)
    rows = [("".join(r.choice("abé") for _ in range(r.randint(0, 30))), "".join(r.choice("abé") for _ in range(r.randint(0, 3))), r.choice([None, *range(-2, 34)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, s string, h int").select("t", "s", "h", X.nearest_occurrence(F.col("t"), F.col("s"), F.col("h")).alias("n"))
    for x in df.collect():
        every = [i for i in range(len(x["t"])) if x["s"] and x["t"].startswith(x["s"], i)]
        assert x["n"] == min(every, key=lambda i: (abs(i - (x["h"] or 0)), i), default=None), x
    assert Q.longest_run(["we", "will", "cut", "the", "tax"], ["cut", "the", "budget"]) == (2, 2)


def test_dumps(spark, tmp_path):
    from pyspark.sql import types as t

    (tmp_path / "x.unl").write_bytes("1|Šťastný|05.01.2026|\n\n2||2026-01-06 09|\nbad|x|05.01.2026|\n3|\n".encode("windows-1250"))
    schema = t.StructType([t.StructField("id", t.IntegerType()), t.StructField("name", t.StringType()), t.StructField("d", t.DateType())])
    out = [(r["id"], r["name"], str(r["d"])) for r in files.read_unl(spark, str(tmp_path / "x.unl"), schema).orderBy("seq").collect()]
    assert out == [(1, "Šťastný", "2026-01-05"), (2, None, "2026-01-06")]
    with pytest.raises(PermissionError):
        sinks.guard_path("/site/public/../public/leads.json", "/site/public", True)
    sinks.guard_path("/site/private/leads.json", "/site/public", True)


def test_partition_replacement_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, term int")
    N.replace_partition(rows((1, 1), (2, 1), (3, 2)), path, "term")
    for _ in range(2):
        N.replace_partition(rows((9, 1)), path, "term")
    assert sorted((r["id"], r["term"]) for r in spark.read.parquet(path).collect()) == [(3, 2), (9, 1)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "yes"), (2, "b", None)], "id int, v string, approved string")
    new = spark.createDataFrame([(1, "x", None), (3, "n", None)], "id int, v string, approved string")
    assert sorted(tuple(r) for r in N.upsert_preserving(old, new, "id", ["approved"]).collect()) == [(1, "x", "yes"), (2, "b", None), (3, "n", None)]
    done, unknown = N.apply_status(old, spark.createDataFrame([(2, "no"), (7, "no")], "id int, approved string"), "id", "approved")
    assert {(r["id"], r["approved"]) for r in done.collect()} == {(1, "yes"), (2, "no")} and [r["id"] for r in unknown.collect()] == [7]
