"""Versioned tables and sinks: repeated batches, untouched buckets, failures, guards."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence.sources import files, sinks
from evidence.streaming.table import VersionedTable
from evidence.streaming.upsert import current, incremental_upsert

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("batch", T.IntegerType())])


def held(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


def test_stream_is_merged(spark, tmp_path):
    landed, target, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        q = incremental_upsert(spark, landed, SCHEMA, target, ["id"], "batch", point)
        q.awaitTermination()
        assert q.exception() is None
    assert held(current(spark, target, SCHEMA, ["id"], "batch")) == [(1, "a"), (2, "c")]


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "batch", buckets=8)
    assert held(table.read()) == [] and table.versions() == []
    assert table.merge(spark.createDataFrame([(i, "a", 1) for i in range(40)], SCHEMA), 0)
    first = table.manifest()
    assert set(first["buckets"].values()) == {1} and len(first["buckets"]) == 8
    # the same batch again: one version, nothing rewritten
    assert not table.merge(spark.createDataFrame([(1, "again", 9)], SCHEMA), 0)
    assert table.versions() == [1] and (1, "a") in held(table.read())
    # one key touches one bucket; an older row of a key does not win
    assert table.merge(spark.createDataFrame([(7, "b", 2), (7, "old", 0), (7, "c", 2)], SCHEMA), 1)
    second = table.manifest()
    assert sorted(second["buckets"].values()) == [1] * 7 + [2]
    assert dict(held(table.read()))[7] == "c" and dict(held(table.read(1)))[7] == "a" and len(held(table.read())) == 40
    # an empty batch is a version without data; then old data goes, and only what no kept version names
    assert table.merge(spark.createDataFrame([], SCHEMA), 2) and table.merge(spark.createDataFrame([(7, "d", 3)], SCHEMA), 3)
    assert table.versions() == [3, 4] and dict(held(table.read()))[7] == "d"
    bucket = next(b for b, v in table.manifest()["buckets"].items() if v == 4)
    data = tmp_path / "t" / "data"
    assert not (data / "v1" / f"bucket={bucket}").exists() and (data / "v2" / f"bucket={bucket}").exists()


def test_a_failed_merge_leaves_the_version_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "batch", buckets=4)
    table.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    broken = spark.createDataFrame([(1, "b", 2)], SCHEMA).withColumn("v", F.when(F.col("id") == 1, F.raise_error("broken")).otherwise(F.col("v")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.merge(broken, 1)
    assert held(table.read()) == [(1, "a")] and table.versions() == [1]
    assert table.merge(spark.createDataFrame([(1, "b", 2)], SCHEMA), 1) and held(table.read()) == [(1, "b")]


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def debates(spark, n):
    m = "array<struct<turn: int, text: string, rawText: string, annotations: array<string>>>"
    rows = [(i, f"t{i}" if i % 2 else None, [(1, "short", "x" * 500, ["a", "b"]), (2, None, None, None)] if i else None) for i in range(n)]
    return spark.createDataFrame(rows, f"id int, title string, messages {m}").repartition(3)


def test_document(spark, tmp_path):
    path = str(tmp_path / "doc")
    people = spark.createDataFrame([(1, "Ann", None), (2, "Bea", "x")], "id int, name string, note string")
    parties = spark.createDataFrame([], "id int, name string")
    sinks.write_document(sinks.dataset(debates(spark, 5), people, parties), path, meta={"term": "10"})
    found = sinks.manifest(spark, path)
    assert found["meta"] == {"term": "10", "debateCount": 5, "messageCount": 8, "annotationCount": 8, "personCount": 2}
    text = "".join(open(os.path.join(path, f)).read() for f in found["sections"]["debates"])
    assert "rawText" not in text and "null" not in text and sorted(json.loads(x)["id"] for x in text.splitlines()) == [0, 1, 2, 3, 4]
    back = sinks.read_section(spark, path, "people", "id int, name string, note string")
    assert sorted(map(tuple, back.collect())) == [(1, "Ann", None), (2, "Bea", "x")]
    assert sinks.read_section(spark, path, "parties", "id int").count() == 0
    # a second write replaces the document and removes its parts
    sinks.write_document(sinks.dataset(debates(spark, 2), people.limit(0), parties), path)
    assert sinks.manifest(spark, path)["meta"] == {"debateCount": 2, "messageCount": 2, "annotationCount": 2}
    assert {f for f in names(path) if not f.endswith(".crc")} == {"dataset.json", *(f for x in sinks.manifest(spark, path)["sections"].values() for f in x)}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "doc")
    broken = sinks.section(spark.range(100).repartition(4), "requests", "n").withColumn("body", F.when(F.col("body").contains(":77"), F.raise_error("broken")).otherwise(F.col("body")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_document(broken, path)
    assert names(path) == []


def test_an_internal_artefact_is_not_public(spark, tmp_path):
    public = str(tmp_path / "public")
    rows = sinks.section(spark.range(3), "leads", "n")
    with pytest.raises(Exception, match="is under the public"):
        sinks.write_document(rows, f"{public}/../public/leads", public=public, internal=True)
    assert names(public) == []
    sinks.write_document(rows, f"{public}/leads", public=public)
    sinks.write_document(rows, str(tmp_path / "private"), public=public, internal=True)
    asked = [("/public/x", True, False), ("/public//x", True, False), ("/public/./x", True, False), ("/publications/x", True, True), ("/public/x", False, True)]
    got = spark.createDataFrame(asked, "p string, i boolean, want boolean").select(sinks.may_stand(F.col("p"), "/public", F.col("i")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_requests_are_added_and_read_once(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("k1", "judge", "m", "s", "ä \n \"q\""), ("k2", "judge", "m", None, "")], sinks.REQUEST)
    sinks.write_requests(rows, path)
    sinks.write_requests(rows.where("cache_key = 'k2'").unionByName(rows.limit(1).withColumn("cache_key", F.lit("k3"))), path)
    got = {r["cache_key"]: r["user"] for r in sinks.read_requests(spark, path).collect()}
    assert got == {"k1": "ä \n \"q\"", "k2": "", "k3": "ä \n \"q\""} and sinks.manifest(spark, path)["meta"] == {"requestCount": 4}


def test_lines_keep_every_byte(spark, tmp_path):
    path = tmp_path / "x.unl"
    path.write_bytes("4|x\x01y|Žluťoučký \"q\" \\ #|\r\n\n 5|'|a b|\n".encode("windows-1250"))
    got = [r["cols"] for r in files.raw_rows(spark, str(path)).orderBy("seq").collect()]
    assert got == [["4", "x\x01y", "Žluťoučký \"q\" \\ #"], [" 5", "'", "a b"]]
