"""Pages, registries, lookups and pluggable models on hand-made input."""

import hashlib

from pyspark.sql import functions as F

from evidence.operators import pages as G
from evidence.operators import pairs as P
from evidence.operators import rows as R
from evidence.sources import files

PAGE = """<html><title>Title</title><body><div class="document-nav"> x </div><div id="main-content"><!--###1#-->5. <b>Budget</b><!--@@-->
<!--###0#12|90500|||Jan|Novak||@@--><p><b><a href="/x" id="r1">Jan Novak</a></b>: Hello&nbsp;all.</p><p>Vote <a href="hlasy.sqw?G=77">77</a> <a href="hlasy.sqw?G=12">12</a></p>
<p class="status">gone</p><!-- turn 71 -->
<!--###0#13||f|Ing.|Eva|Mala|x|@@--><p>No anchor here.</p><a name="_d"></a> footer</div></body></html>"""
BALLOT = """<h1>3. schůze, 17. hlasování, 5. ledna 2026, 14:05 Návrh zákona</h1><p>NÁVRH BYL PŘIJAT</p><p>Ano: 2 Ne: 1 Nepřihlášen: 1 Omluven: 2</p>
<h2><span>ABC (3)</span></h2><ul class="results"><li><span class="flag yes">A</span> <a href="detail.sqw?id=5&x">Jan&nbsp;Novak</a></li><li><span class="flag odd">?</span> <a href="detail.sqw?id=6">Eva</a></li></ul>
<h2><span>XY (1)</span></h2><ul class="results"><li><span class="flag no">N</span> <a href="detail.sqw?id=7">Petr</a></li></ul>"""


def test_speeches(spark):
    rows = G.speeches_from_html(spark.createDataFrame([("http://h/b07012345.htm", PAGE)], "url string, html string"), "url", "html").orderBy("ord").collect()
    a, b = rows
    assert (a["person_id"], a["clock"], a["last_name"], a["anchor"], a["turn"], a["ballots"], a["section"]) == ("12", "90500", "Novak", "r1", 70, ["12", "77"], "5. Budget")
    assert a["text"] == "Hello all.\nVote 77 12" and (b["turn"], b["anchor"], b["title"], b["text"]) == (71, "", "Ing.", "No anchor here.")


def test_ballot(spark):
    pages = spark.createDataFrame([("u", BALLOT)], "url string, html string")
    r = G.ballots_from_html(pages, "url", "html").first()
    assert (r["session"], r["number"], r["clock"], r["subject"], r["result"]) == (3, 17, "14:05", "Návrh zákona", "NÁVRH BYL PŘIJAT")
    assert r["declared"] == {"PRO": 2, "PROTI": 1, "NEPRIHLASEN": 3}
    votes = {v["person_id"]: (v["name"], v["club"], v["vote"], v["known"]) for v in G.votes_from_html(pages, "url", "html").collect()}
    assert votes == {"5": ("Jan Novak", "ABC", "PRO", True), "6": ("Eva", "ABC", "NEPRIHLASEN", False), "7": ("Petr", "XY", "PROTI", True)}


def test_commitments(spark):
    rows = spark.createDataFrame([("k1", '```json\n[{"citace": " cut tax "}, {"citace": "absent"}, {}, {"citace": ""}]\n```', "We cut tax now"), ("k2", "broken", "x")], "chapter string, answer string, text string")
    out = G.commitments_from_json(rows, "chapter", "answer", "text").collect()
    assert [(r["quote"], r["char_start"], r["char_end"], r["id"]) for r in out] == [("cut tax", 3, 10, "pz-" + hashlib.sha1(b"k1::cut tax").hexdigest()[:16])]


def test_chapters(spark):
    html = "<h2 id='a'>One</h2><p>x</p><h2 id=\"b\">Two</h2><p>y</p><p>z</p>"
    out = R.chapters(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", ["a", "b"]).collect()
    assert [(r["chapter"], r["title"], r["text"]) for r in out] == [("a", "One", "x"), ("b", "Two", "y\nz")]
    try:
        R.chapters(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", ["a"]).collect()
        raise AssertionError("must fail")
    except Exception as e:
        assert "chapters are not the expected ones" in str(e)


def test_article_date(spark):
    pages = [
        (1, '<meta property="article:published_time" content="2024-05-06T10:00">'), (2, '<time datetime="2024-01-02T05:00">x</time>'), (3, '<time datetime="2999-01-02">x</time>'), (4, "none"),
    ]
    out = {r["id"]: (r["date"], r["reason"] is None) for r in R.article_date(spark.createDataFrame(pages, "id int, html string"), "html", F.lit("2025-01-01").cast("date")).collect()}
    assert out == {1: ("2024-05-06", True), 2: ("2024-01-02", True), 3: (None, False), 4: (None, False)}


def test_registry_and_lookup(spark, tmp_path):
    t = files.registry(
        spark.createDataFrame([(1, "A")], "person_id int, name string"),
        spark.createDataFrame([(10, 1, "ABC"), (20, 5, "GOV"), (30, 7, "other")], "organ_id int, type int, abbr string"),
        spark.createDataFrame([(1, 10, 0), (1, 10, 1), (1, 20, 0), (1, 30, 0)], "person_id int, organ_id int, function int"),
        spark.createDataFrame([(5, 1, 9), (6, 1, 8)], "deputy_id int, person_id int, term int"),
        9,
    )
    assert t["club_memberships"].count() == t["government_memberships"].count() == t["deputies"].count() == 1
    (tmp_path / "l.csv").write_text("domain,tier,note\n Example.COM ,2,x\nbad,none,y\n")
    assert [(r["domain"], r["tier"]) for r in files.read_lookup(spark, str(tmp_path / "l.csv")).collect()] == [("example.com", 2)]


def test_series(spark):
    stat = spark.createDataFrame([(["2024M01", "2024M02", "2024M03"], [1.236, None, 3.0])], "labels array<string>, vals array<double>")
    assert [(r["month"], r["value"]) for r in files.json_stat(stat, "labels", "vals").collect()] == [("2024-01", 1.24), ("2024-03", 3.0)]
    lines = ["datum|1 USD|1 EUR", "02.01.2024|22,5|24,5", "03.01.2024|22,6|24,7", "01.02.2024|x|25,1", "bad"]
    out = files.fx_table(spark.createDataFrame(list(enumerate(lines)), "seq int, line string"), "line").collect()
    assert sorted((r["month"], r["value"]) for r in out) == [("2024-01", 24.6), ("2024-02", 25.1)]


def test_pluggable_models(spark):
    rows = spark.createDataFrame([(1, "a", "bb"), (2, "ccc", None)], "id int, a string, b string")
    scored = P.score_pairs(rows, lambda x, y: [(0.1, 0.2, 0.7 if q else 0.0) for p, q in zip(x, y, strict=True)], "a", "b").collect()
    assert {r["id"]: r["contradiction"] for r in scored} == {1: 0.7, 2: 0.0}
    vectors = {r["id"]: r["vector"] for r in P.embed_texts(rows, lambda texts: [[float(len(x)), 0.0] for x in texts], "b").collect()}
    assert vectors == {1: [1.0, 0.0], 2: [0.0, 0.0]}
