"""Dumps, model answers, gates, checks and the ledger on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidence.functions import rules as R
from evidence.functions import text as X
from evidence.operators import checks as K
from evidence.operators import evaluation as E
from evidence.operators import gates as G
from evidence.operators import votes as V
from evidence.sources import dumps, files

D = dt.date(2026, 4, 14)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_dumps_keep_one_term_and_its_children(spark, tmp_path):
    ballot = lambda i, organ, item, pro: f"{i}|{organ}|5|{i[1]}|{item}|01.01.2026|10:00|{pro}|1|0|0|9|5||A|Šablona|"
    lines = {
        "sessions": ["s1|174|5|", "s1|174|6|", "s2|173|7|", "s3|174|x|", "s4|174|"],
        "agenda": ["i1|s1|82||3|Bod|ref|", "i2|s1|||x|Bod|", "i3|s2|1||1|Bod|"],
        "turns": ["t1|174|5|12|", "t2|173|5|13|", "t3|174|5|x|"],
        "records": ["t1|p1|1|i1|4|", "t1|p2|2|0|", "t1|p3|3||", "t2|p4|4|i1|", "t1|p5|x|i1|", "t1|p6|6|i1|"],
        "ballots": [ballot("b1", 174, "", 5), ballot("b2", 174, 3, "x"), ballot("b3", 173, 3, 5)],
        "votes": ["d1|b1|A|", "d1|b2|A|", "d2|b3|B|"],
        "annulled": ["b1|", "b1|", "b9|"],
        "excuses": ["174|d1|01.01.2026||10:00|", "173|d2|01.01.2026|||"],
    }
    raw = {}
    for name, text in lines.items():
        (tmp_path / name).write_bytes(("\r\n".join(text) + "\n\n").encode("windows-1250"))
        raw[name] = files.raw_rows(spark, str(tmp_path / name))
    t = dumps.parse_vote_dumps(raw, "174")
    assert rows(t["sessions"]) == [("s1", "174", 6)]
    assert rows(t["agenda"], "item_id", "bill_id", "item", "bill_ref") == [("i1", "82", 3, "ref"), ("i2", None, None, "")]
    assert rows(t["turns"]) == [("t1", "174", 5, 12)]
    assert rows(t["records"], "person", "anchor", "item_id", "kind", "turn") == [("p1", 1, "i1", "4", 12), ("p6", 6, "i1", None, 12)]
    assert rows(t["ballots"], "ballot", "item", "pro", "title") == [("b1", 0, 5, "Šablona")]
    assert rows(t["votes"], "deputy", "ballot", "code") == [("d1", "b1", "A")]
    assert rows(t["annulled"]) == [("b1",)]
    assert rows(t["excuses"], "deputy", "since", "until") == [("d1", "", "10:00")]


@pytest.mark.parametrize("title, bill, phase", [
    ("3. Návrh zákona /sněmovní tisk 82/ - třetí čtení", "82", "3. čtení"), ("Novela /tisk 9/2/ - druhé čtení", "9", "2. čtení"), ("Zákon /tisk 7/ 1. čtení", "7", "1. čtení"),
    ("Návrh na vyslovení nedůvěry vládě", None, "Hlasování o nedůvěře"), ("vyslovení důvěry", None, "Hlasování o důvěře"), ("Písemné interpelace", None, "Písemné interpelace"),
    ("Zpráva /sněmovní tisk 5/", "5", "Obecná rozprava"), ("Zahájení", None, None), ("", None, None), (None, None, None),
])
def test_phase(spark, title, bill, phase):
    t = F.lit(title).cast("string")
    assert (one(spark, X.bill_of_title(t)), one(spark, X.phase(t))) == (bill, phase)


@pytest.mark.parametrize("answer, contradiction, holds", [
    ('{"rozporMizi": false, "parovaniPlati": true}', False, True), ("```json\n{\"rozporMizi\": 0, \"parovaniPlati\": 1}\n```", False, True), ('{"rozporMizi": null, "parovaniPlati": null}', False, False),
    ('{"rozporMizi": "false", "parovaniPlati": "ano"}', True, True), ('{"rozporMizi": "", "parovaniPlati": []}', False, False), ("{}", True, False), ("broken", True, False), ("[1]", True, False), (None, True, False),
])
def test_answers_have_safe_defaults(spark, answer, contradiction, holds):
    a = F.lit(answer).cast("string")
    assert one(spark, X.challenge_answer(a))["contradiction"] is contradiction
    assert one(spark, X.pairing_check(a))["holds"] is holds


def test_answers_are_cut_and_must_be_offered(spark):
    assert len(one(spark, X.challenge_answer(F.lit('{"vyklad": "' + "x" * 400 + '"}')))["reading"]) == 250
    answers = [(1, '{"cisloTisku": " 82 ", "zduvodneni": "a"}'), (2, '{"cisloTisku": 82}'), (3, '{"cisloTisku": "83"}'), (4, "{}"), (5, "broken"), (6, '{"cisloTisku": 0}')]
    out = X.proposed_pairs(spark.createDataFrame(answers, "id int, answer string"), "answer", spark.createDataFrame([("82",), ("82",), ("0",)], "bill string"), "bill")
    assert rows(out, "id", "bill", "reason") == [(1, "82", "a"), (2, "82", "")]


def test_claim_text(spark):
    c = lambda *x: one(spark, X.claim_text(*[F.lit(v).cast("string") for v in x]))
    assert c("said", "s", "p", "o", "2020") == "said" and c(None, "s", None, "o", "2020") == "s o (2020)" and c(None, "s", "p", "o", R.NO_FRAME) == "s p o" and c(None, None, None, None, None) == ""


def test_final_votes_need_a_known_ballot_of_the_page(spark):
    claims = spark.createDataFrame([(1, 10, [10], 5, 5), (2, 10, [11], 5, 5), (3, 10, [], 5, 5), (4, 10, None, 5, 6), (5, 12, None, 5, 5), (6, 13, None, 5, 5), (7, None, None, 5, 5)], "id int, ballot int, links array<int>, session int, final_session int")
    known, annulled = spark.createDataFrame([(10,), (12,)], "ballot int"), spark.createDataFrame([(12,)], "ballot int")
    assert rows(V.linked_finals(claims, known, annulled, "ballot", "links", ("session", "final_session")), "id") == [(1,), (3,)]
    assert rows(V.linked_finals(claims, known, annulled, "ballot"), "id") == [(1,), (2,), (3,), (4,)]


def test_resolved_votes(spark):
    asked = spark.createDataFrame([("b1", "p1", "d1", True), ("b1", "p2", None, True), ("b2", "p1", "d1", True), ("b1", "p9", "d9", False)], "ballot string, person string, deputy string, excused boolean")
    votes = spark.createDataFrame([("b1", "p1", "PRO", "X"), ("b1", "p2", "NEPRIHLASEN", None), ("b2", "p1", "PRO", "X")], "ballot string, person string, value string, club string")
    out = V.resolve_vote(asked, votes, spark.createDataFrame([("b2",)], "ballot string"), "ballot", "person", "value", "NEPRIHLASEN", ["club"], spark.createDataFrame([("b1", "A", "u1")], "ballot string, result string, url string"), "deputy", "excused")
    assert rows(out, "person", "value", "present", "club", "excused", "result", "url") == [("p1", "PRO", True, "X", True, "A", "u1"), ("p2", "NEPRIHLASEN", False, None, False, "A", "u1")]


def test_ledger_leaves_out_chairs_and_others(spark):
    m = spark.createDataFrame([("d", 1, 7, "p1", "Ann", False), ("d", 2, 7, "p1", "Ann B", False), ("d", 3, 7, "p2", "Chair", True), ("d", 4, 8, "p3", "Eve", None), ("d", 5, 7, "p4", "Guest", False)], "debate string, pos int, item int, person string, name string, chair boolean")
    b = spark.createDataFrame([(7, "b1", "Zákon jako celek", "A"), (7, "b2", "Pořad schůze", "R"), (8, "b3", "x", "A")], "item int, ballot string, subject string, result string")
    v = spark.createDataFrame([("b1", "p1", "A", True), ("b2", "p1", "?", False), ("b1", "p2", "A", False), ("b3", "p1", "A", False)], "ballot string, person string, value string, excused boolean")
    deputies = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "person string")
    out = V.ledger(m, b, v, "debate", "item", "pos", "ballot", "person", "name", "value", ["A"], "NEPRIHLASEN", "chair", deputies)
    assert rows(out, "ballot", "name", "value", "excused") == [("b1", "Ann", "A", True), ("b2", "Ann", "NEPRIHLASEN", False)]
    t = spark.createDataFrame([("b1", "Y", 1), ("b1", "X", 2)], "ballot string, club string, pro int")
    got = V.ledger_ballots(m, b, t, "debate", "item", "pos", "ballot", "subject", "result", "club").collect()
    assert {(r["ballot"], r["kind"], r["passed"], tuple(map(tuple, r["groups"] or []))) for r in got} == {("b1", "SUBSTANTIVE_FINAL", True, (("X", 2), ("Y", 1))), ("b2", "PROCEDURAL_AGENDA", False, ())}


def test_annotation_gate_is_all_or_nothing(spark):
    proofs = [(1, ("a  quote", "u1", "Hlasování č. 7, 14. schůze (14. 4. 2026)")), (2, ("a quote", "u1", None)), (3, ("a quote", "u2", None)), (4, ("other", "u1", None)), (5, None), (6, ("a quote", "", None)),
              (7, ("a quote", "u1", "Hlasování č. 7, 15. schůze (29. 5. 2026)")), (8, ("a quote", "u1", "Hlasování č. 9")), (9, ("a quote", "u1", "Hlasování")), (10, ("a quote", "u1", "č. 8, 3. schůze (40. 1. 2026)")), (11, (" ", "u1", None))]
    a = spark.createDataFrame(proofs, "id int, proof struct<pastQuote string, sourceUrl string, votingBallotId string>")
    pages = spark.createDataFrame([("u1", "here is a\nquote.")], "url string, text string")
    ballots = spark.createDataFrame([("7", 14, D), ("8", None, None)], "ballot string, session int, date date")
    out = G.gate_annotations(a, pages, ballots)
    assert dict(rows(out, "id", "reason")) == {
        1: None, 2: None, 3: "no page", 4: "quote not found", 5: "no proof", 6: "no address", 7: "session differs; date differs", 8: "ballot missing", 9: "no number", 10: None, 11: "no quote",
    }
    written = []
    with pytest.raises(ValueError):
        G.publish_gated(out, written.append)
    assert not written
    G.publish_gated(out.where("reason is null"), lambda df: written.append(df.count()))
    assert written == [3]


ANN = """struct<start int, `end` int, targetSnippet string, type string, severity string, shortBadgeLabel string, explanation string, proof struct<pastQuote string, pastDate string, pastContext string, sourceUrl string, voteRecorded string>,
  confidenceScore double, presentationTier string, nliRelation string, claimCategory string, mediaEvidence struct<exactTimestampSeconds int, archiveUrl string>, adversarialCheck struct<passed boolean>>"""


@pytest.mark.parametrize("change, errors", [
    ({}, []), ({"explanation": None, "type": "?"}, ["missing explanation"]), ({"start": -1}, ["span out of range"]), ({"end": 99}, ["span out of range"]), ({"start": 1, "end": 0}, ["span out of range"]),
    ({"targetSnippet": "x"}, ["span is not the snippet"]), ({"confidenceScore": 1.5}, ["score out of range"]), ({"confidenceScore": 0.79, "presentationTier": None}, ["score too low"]),
    ({"presentationTier": "?"}, ["unknown tier"]), ({"presentationTier": "CONTEXT_DEVELOPMENT"}, ["tier differs"]), ({"confidenceScore": None}, ["tier differs"]), ({"nliRelation": "?"}, ["unknown relation"]),
    ({"claimCategory": "?"}, ["unknown category"]), ({"proof": ("q", "", None, "u", "?")}, ["proof without pastDate", "proof without pastContext", "unknown vote"]),
    ({"mediaEvidence": (-1, "u")}, ["bad media time"]), ({"mediaEvidence": (None, None)}, ["bad media time", "media without address"]), ({"adversarialCheck": (None,)}, ["check without result"]),
])
def test_schema_of_annotations(spark, change, errors):
    good = {"start": 0, "end": 5, "targetSnippet": "Žlutý", "type": "VALUE_SHIFT", "severity": "HIGH", "shortBadgeLabel": "l", "explanation": "e", "proof": ("q", "d", "c", "u", None), "confidenceScore": 0.96,
            "presentationTier": "PUBLISHED", "nliRelation": "", "claimCategory": None, "mediaEvidence": None, "adversarialCheck": None}
    df = spark.createDataFrame([(tuple((good | change).values()), "Žlutý kůň")], f"a {ANN}, text string")
    assert df.select(G.annotation_errors(F.col("a"), F.col("text")).alias("e")).first()["e"] == errors


def test_schema_of_debates(spark):
    message = f"struct<messageId string, speaker string, party string, role string, timestamp string, date string, cleanText string, hasAnomalies boolean, speechAct string, annotations array<{ANN}>>"
    schema = ", ".join(f"{k} string" for k in R.DEBATE_KEYS if k != "messages") + f", messages array<{message}>"
    bad = (0, 9, "x", "?", "HIGH", "l", "e", ("q", "d", "c", "u", None), None, None, None, None, None, None)
    messages = [("m1", "s", "p", "r", "t", "d", "text", False, "OWN_STANCE", []), ("m2", "s", None, "r", "t", "d", "text", False, "?", [bad]), ("m3", "s", "p", "r", "t", "d", "text", False, None, None)]
    df = spark.createDataFrame([("x",) * 9 + (messages,), (None,) + ("x",) * 8 + (messages,), ("x",) * 9 + ([],)], schema)
    got = [r["errors"] for r in G.debate_errors(df).collect()]
    assert got == [["m2: missing party", "m2: unknown act", "m2: unknown type", "m2: span out of range", "m3: missing annotations"], ["missing debateId"], []]
    assert all(r["errors"] == ["missing title"] for r in G.debate_errors(df.drop("title").where("debateId is not null")).collect())


def _day(spark):
    """A sound sitting day: three speeches, two ballots."""
    speeches = [("d", D, 5, 1, 1, True, "u", "a1", "Ann", "p1", "Hello all ***", 36000), ("d", D, 5, 2, 1, True, "u", "a2", "Bob", "p2", "Good  day", 36600), ("d", D, 5, 3, 2, True, "v", "a1", "Ann", "p1", "End", 36570)]
    page = [("d", 1, "u", "a1", "Ann", "p1", "Hello all of you"), ("d", 1, "u", "a2", "Bob", "", "Good day"), ("d", 2, "v", "a1", "Ann", "p1", "End")]
    return {
        "speeches": spark.createDataFrame(speeches, "day string, date date, session int, pos int, turn int, anchor_verified boolean, url string, anchor string, title string, person string, text string, second int"),
        "page": spark.createDataFrame(page, "day string, turn int, url string, anchor string, label string, person string, text string"),
        "mentions": spark.createDataFrame([("d", 2, "b1", "p2", "PRO"), ("d", 3, "b2", None, None)], "day string, pos int, ballot string, person string, vote_of_speaker string"),
        "ballots": spark.createDataFrame([("b1", 5, D, 36500), ("b2", 5, D + dt.timedelta(1), 40000)], "ballot string, session int, date date, second int"),
        "votes": spark.createDataFrame([("b1", "p1", "PRO", "X"), ("b1", "p2", "PRO", None)], "ballot string, person string, value string, club string"),
        "declared": spark.createDataFrame([("b1", "PRO", 2)], "ballot string, value string, declared long"),
        "clubs": spark.createDataFrame([("p1", "X", 1, D, None)], "person string, club string, seq int, since date, until date"),
        "facts": spark.createDataFrame([("f1", "CLUB_MEMBERSHIP", "p1", "X", "X", D, None), ("f2", "VOTE_CAST", "p2", "b1", "PRO", D, D)], "fact_id string, predicate string, subject string, object string, literal string, valid_from date, valid_to date"),
        "messages": spark.createDataFrame([("Hello\nmore", "xx Hello yy")], "clean string, raw string"),
    }


def test_source_checks(spark):
    good = _day(spark)
    report = {r["name"]: r for r in K.source_crosscheck(**good).collect()}
    assert len(report) == 13 and all(r["ok"] for r in report.values()) and not report["ballot within the speech"]["blocking"]
    assert {n: report[n]["total"] for n in ("anchor on a page", "person of the anchor", "fact of the vote", "club of the register", "tally as declared")} == {"anchor on a page": 3, "person of the anchor": 2, "fact of the vote": 1, "club of the register": 1, "tally as declared": 2}

    groups = {K.page_checks: "speeches page", K.time_checks: "speeches mentions ballots", K.vote_checks: "votes ballots declared clubs mentions facts", K.text_check: "messages"}

    def failing(**changes):
        checks = {}
        for group, names in groups.items():
            if set(changes) & set(names.split()):
                checks |= group(*[(good | changes)[n] for n in names.split()])
        return {r["name"] for r in G.check_report(checks).collect() if not r["ok"]}

    speeches, page = good["speeches"], good["page"]
    later = F.when(F.col("pos") == 3, 36000).otherwise(F.col("second"))
    assert failing(speeches=speeches.withColumn("second", later)) == {"times in order", "ballot within the speech"}
    assert failing(page=page.withColumn("label", F.lit("Bob")).limit(3)) == {"anchor of the same speaker"}
    assert failing(page=page.where("anchor = 'a1'")) == {"anchor of the same speaker", "coverage of the day"}
    assert failing(page=page.withColumn("person", F.lit("p1")), speeches=speeches.withColumn("text", F.lit(""))) == {"person of the anchor", "text of the page"}
    assert failing(ballots=good["ballots"].withColumn("session", F.lit(6))) == {"ballot of this sitting"}
    assert failing(ballots=good["ballots"].withColumn("date", F.lit(D - dt.timedelta(1)))) == {"ballot of this sitting", "club of the register", "fact of the club"}
    assert failing(declared=good["declared"].withColumn("declared", F.lit(3))) == {"tally as declared"}
    assert failing(facts=good["facts"].where("predicate = 'none'")) == {"fact of the vote", "fact of the club"}
    assert failing(messages=good["messages"].withColumn("raw", F.lit("xx"))) == {"clean text of the speech"}
    empty = {k: v.limit(0) for k, v in good.items()}
    assert all(r["ok"] and r["total"] == 0 for r in K.source_crosscheck(**empty).collect())


def test_evaluation(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, True), (True, None)], "e boolean, g boolean")
    assert rows(E.precision_recall(df, F.col("e"), F.col("g"))) == [(1, 2, 2, round(1 / 3, 6), round(1 / 3, 6))]
    assert rows(E.precision_recall(df.limit(0), F.col("e"), F.col("g"))) == [(0, 0, 0, None, None)]
    m = E.confusion_matrix(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "x string, y string"), "x", "y", {"a": "as_a", "b": "as_b"})
    assert rows(m, "x", "as_a", "as_b", "recall", "accuracy") == [("a", 1, 1, 0.5, 0.666667), ("b", None, 1, 1.0, 0.666667)]
    keyed = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(E.pending(keyed, keyed, ["k"])) == [(None,)]
    verdicts = spark.createDataFrame([("a", 1, "no"), ("a", 2, "yes")], "k string, at int, verdict string")
    assert rows(E.verdict_left_join(keyed, verdicts, ["k"], "at"), "k", "verdict") == [("a", "yes"), (None, None)]
    assert rows(E.band_filter(spark.createDataFrame([(0.8, 0.95), (0.5, 1.0), (0.49, 1.0), (0.9, 0.94), (None, 1.0)], "s double, m double"), F.col("s"), F.col("m"), 0.5, 0.8, 0.95), "s", "band") == [(0.5, "lead"), (0.8, "tribunal")]


def test_no_text_travels_with_commitments(spark):
    from evidence.operators import gates

    stored = spark.createDataFrame([(1, "a", 7, 2), (1, "x", 7, 2), (1, None, 7, 2), (2, "a", 7, 2), (3, "a", 7, 2), (1, "a", 8, 2), (1, "a", 9, 2), (1, "a", 7, 3)], "chapter int, quote string, ballot int, n int")
    chapters = spark.createDataFrame([(1, "has a"), (2, None)], "chapter int, text string")
    ballots, annulled = spark.createDataFrame([(7,), (9,)], "ballot int"), spark.createDataFrame([(9,)], "ballot int")
    tallies = spark.createDataFrame([(7, 2), (9, 2)], "ballot int, data_n int")
    out = gates.gate_commitment(stored, chapters, ballots, annulled, tallies, ["ballot"], ["n"])
    got = {(r["chapter"], r["quote"], r["ballot"], r["n"]): r["reason"] for r in out.collect()}
    assert got == {
        (1, "a", 7, 2): None, (1, "x", 7, 2): "quote not in text", (1, None, 7, 2): "quote not in text", (2, "a", 7, 2): "chapter missing", (3, "a", 7, 2): "chapter missing",
        (1, "a", 8, 2): "ballot missing", (1, "a", 9, 2): "ballot annulled", (1, "a", 7, 3): "tally differs",
    }
    twice = gates.gate_commitment(stored.limit(1), chapters.union(chapters), ballots, annulled, tallies, ["ballot"], ["n"])
    assert twice.count() == 2
    assert "_text" not in out._jdf.queryExecution().optimizedPlan().toString()


def _sittings(spark):
    m = spark.createDataFrame([(d, i, 5, i % 2, f"n{d}") for d in (1, 2, 3) for i in range(4)] + [(4, 0, 6, 0, "n4")], "debate int, pos int, item int, person int, name string")
    b = spark.createDataFrame([(70, 5, "Novela", "A"), (71, 5, "Novela", "R"), (72, 9, "Novela", "A")], "ballot int, item int, subject string, result string")
    return m, b


def _first_join(df):
    return next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_votes_are_repeated_for_debates_last(spark):
    m, b = _sittings(spark)
    v = spark.createDataFrame([(70, 0, "A", True), (70, 1, "X", False), (71, 1, "N", True), (72, 0, "A", True), (70, 3, "A", True)], "ballot int, person int, flag string, excused boolean")
    out = V.ledger(m, b, v, "debate", "item", "pos", "ballot", "person", "name", "flag", ["A", "N"], "NONE")
    assert out.columns == ["debate", "item", "ballot", "person", "name", "flag", "excused"]
    assert sorted(tuple(r) for r in out.collect()) == sorted((d, 5, *x) for d in (1, 2, 3) for x in [(70, 0, f"n{d}", "A", True), (70, 1, f"n{d}", "NONE", False), (71, 1, f"n{d}", "N", True)])
    assert "item#" in _first_join(out) and "ballot#" not in _first_join(out)


def test_ballots_are_told_before_they_are_repeated(spark):
    m, b = _sittings(spark)
    t = spark.createDataFrame([(70, "c", 1)], "ballot int, club string, pro int")
    out = V.ledger_ballots(m, b, t, "debate", "item", "pos", "ballot", "subject", "result", "club")
    got = sorted((r["debate"], r["ballot"], r["passed"], [tuple(x) for x in r["groups"] or []]) for r in out.collect())
    assert got == sorted((d, *x) for d in (1, 2, 3) for x in [(70, True, [("c", 1)]), (71, False, [])])
    assert "item#" in _first_join(out) and "ballot#" not in _first_join(out)
