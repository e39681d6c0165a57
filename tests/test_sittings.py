"""Clock digits in a stream and at once."""

import random

from pyspark.sql import functions as F

from evidence.functions import text as X
from evidence.operators import sequential as Q
from evidence.streaming.sittings import clocks

SCHEMA = "day string, room int, pos int, digits string"


def speeches():
    r = random.Random(4)
    rows = []
    for day in ("a", "b", None):
        at = 8 * 3600
        for pos in range(30):
            at = (at + r.choice((60, 600, 4000))) % 86400
            text = f"{at // 3600:02}{at % 3600 // 60:02}" + (f"{at % 60:02}" if pos % 3 else "")
            rows.append((day, 1, pos, r.choice((text, text.lstrip("0"), None if pos % 7 == 3 else text, "x" if pos % 11 == 5 else text))))
    return rows


def plain(df):
    return sorted(((r["day"], r["pos"], r["at"]) for r in df.collect()), key=str)


def test_stream_and_table_give_equal_rows(spark, tmp_path):
    rows = speeches()
    whole = spark.createDataFrame(rows, SCHEMA)
    want = plain(Q.ambiguous_clocks(whole, ["day", "room"], "pos", "digits"))
    assert plain(clocks(whole, ["day", "room"], "pos", "digits")) == want and sum(x[2] is not None for x in want) > 60
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 11), (11, 12), (12, 30)):  # three micro-batches, each a run of its own that resumes
        spark.createDataFrame([x for x in rows if low <= x[2] < high], SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        stream = clocks(spark.readStream.schema(whole.schema).parquet(landed), ["day", "room"], "pos", "digits")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    assert plain(spark.read.parquet(out)) == want


def test_worded_dates(spark):
    texts = ["12. schůze, 7. hlasování, 5. LEDNA 2026, 14:05", "31. února 2026", "1.září2025 a 2. října 2025", "5. smrště 2026", "schůze", None]
    got = [r[0] and str(r[0]) for r in spark.createDataFrame([(x,) for x in texts], "t string").select(X.worded_date(F.col("t"))).collect()]
    assert got == ["2026-01-05", None, "2025-09-01", None, None, None]


def _small_groups():
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3, 4]), r.choice([None, "x", "y"]), i, r.choice("abc"), r.choice([None, "", "930", "1015", "2350", "10", "x"])) for i in range(150)]
    groups = {}
    for row in rows:
        groups.setdefault(row[:2], []).append(row)
    return rows, groups


def test_clocks_of_groups_over_several_batches(spark):
    rows, groups = _small_groups()
    df = spark.createDataFrame(rows, "g int, h string, pos int, label string, digits string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = Q.ambiguous_clocks(df, ["g", "h"], "pos", "digits")
        got = {r["pos"]: r["at"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r[2]: at for own in groups.values() for r, at in zip(own, Q.resolve_clock([x[4] for x in own])[0], strict=True)}
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()  # no call for each group


def test_anchors_of_groups_over_several_batches(spark):
    rows, groups = _small_groups()
    df = spark.createDataFrame(rows, "g int, h string, pos int, label string, digits string").repartition(3)
    right = df.where("pos % 4 <> 0").select("g", "h", "pos", "label", F.concat(F.lit("p"), "pos").alias("anchor"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = Q.greedy_anchor_match(df, right, ["g", "h"], "pos", "label", "anchor")
        got = {r["pos"]: r["anchor"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for own in groups.values():
        other = [r for r in own if r[2] % 4]
        for r, hit in zip(own, Q.match_in_order([r[3] for r in own], [r[3] for r in other]), strict=True):
            expected[r[2]] = None if hit is None else f"p{other[hit][2]}"
    assert got == expected
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()  # no call for each group
