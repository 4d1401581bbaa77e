"""Sources, sinks and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.sources import catalog as C
from archivolt.sources import sinks as K
from archivolt.sources import tables as B
from archivolt.streaming import counters, limits


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_catalog_csv(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.csv").write_bytes('﻿Name;title;page_count\r\n"x/AB_007.pdf";"a;""b""\nc"; 12 \r\n;;\r\nAB_8;;\r\n'.encode())
    raw = C.read_csv(spark, str(p))
    got = C.typed(raw, ("Name", "page_count"), "Name")
    assert rows(got.select("document", "title", "page_count")) == [("AB_007", 'a;"b"\nc', 12), ("AB_8", None, None)]
    with pytest.raises(ValueError, match="lacks column size"):
        C.typed(raw, ("size",), "Name")
    C.write_csv(got.select("document", "title"), str(tmp_path / "out"))
    assert rows(C.read_csv(spark, str(tmp_path / "out"))) [0] == ("AB_007", 'a;"b"\nc')


def test_keys(spark):
    df = spark.createDataFrame([("a/b/AB_009.pdf_MD", 3)], "n string, p int")
    key = C.document_key(F.col("n"))
    assert tuple(df.select(key, C.serial(key), C.page_key(key, F.col("p"))).first()) == ("AB_009", 9, "AB_011")
    with pytest.raises(Exception, match="not a document key"):
        spark.createDataFrame([("nothing",)], "n string").select(C.document_key(F.col("n"))).collect()


def test_snapshot_names(spark):
    known = spark.createDataFrame([("2024-01-01.csv", "2024-01-01", "h1")], "name string, day string, sha256 string")
    at = dt.datetime(2024, 1, 1, 17, 5, 6)
    new = spark.createDataFrame([("2024-01-01", "h1", at), ("2024-01-01", "h2", at), ("2024-01-02", "h1", at)], "day string, sha256 string, fetched_at timestamp")
    got = {(r["day"], r["sha256"]): (r["name"], r["reused"]) for r in C.snapshot_names(new, known).collect()}
    assert got == {("2024-01-01", "h1"): ("2024-01-01.csv", True), ("2024-01-01", "h2"): ("2024-01-01T120506.csv", False), ("2024-01-02", "h1"): ("2024-01-02.csv", False)}


def test_absent_parts_are_null(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert B.optional_parquet(spark, str(tmp_path / "none"), schema).collect() == []
    spark.createDataFrame([(1, 2)], "A long, c int").write.parquet(str(tmp_path / "t"))
    assert rows(B.optional_parquet(spark, str(tmp_path / "t"), schema)) == [(1, None)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2, "b": "y"}\n')
    assert rows(B.json_lines(spark, str(tmp_path / "x.jsonl"), schema, strict=False)) == [(1, None), (2, "y")]
    with pytest.raises(Exception, match="(?i)malformed"):
        B.json_lines(spark, str(tmp_path / "x.jsonl"), schema, strict=True).collect()


def test_publish_switches_in_one_step(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    a = K.publish({"t": spark.range(2)}, root)
    assert K.published(spark, root, "t").count() == 2
    b = K.publish({"t": spark.range(5)}, root)
    assert a != b and K.published(spark, root, "t").count() == 5
    with pytest.raises(Exception, match="boom"):
        K.publish({"t": spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))}, root)
    assert K.published(spark, root, "t").count() == 5


def test_only_changed_rows_are_sent(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "id int, t string, n int")
    sent = a.withColumn("hash", K.row_hash(a))
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, "z", 1)], "id int, t string, n int")
    assert [r["id"] for r in sorted(K.changed_rows(b, sent, "id").collect())] == [2, 3]


def test_archives_and_reports(spark):
    f = spark.createDataFrame([("g", "b", "h2", 5), ("g", "a", "h1", 7)], "grp string, name string, sha256 string, bytes long")
    one = K.archive_identity(f, "grp").first()
    assert (one["files"], one["bytes"]) == (2, 12)
    assert one["identity"] == K.archive_identity(f.orderBy("name"), "grp").first()["identity"]
    other = spark.createDataFrame([("b", "h2", 5), ("a", "hx", 7), ("c", "h", 1)], "name string, sha256 string, bytes long")
    assert dict(rows(K.verify_report(f, other, "name"))) == {"ok": 1, "hash": 1, "extra": 1}
    bad = K.violations(f, {"small": F.col("bytes") < 6, "no hash": F.col("sha256").isNull()}, "name")
    assert rows(bad) == [("b", "small")]
    with pytest.raises(ValueError, match="not eligible"):
        K.require_none(bad)
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (9,)], "n int").select(K.retry_seconds(F.col("n"))).collect()] == [5.0, 15.0, 300.0]


def test_geojson(spark):
    df = spark.createDataFrame([("p", 40.7, -74.0), ("q", None, 1.0)], "label string, lat double, lon double")
    got = [json.loads(r["feature"]) for r in K.geojson(df).collect()]
    assert got == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-74.0, 40.7]}, "properties": {"label": "p"}}]


def test_limiter_on_a_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "k string, ts timestamp"
    src = tmp_path / "hits"
    spark.createDataFrame([("a", t(0)), ("a", t(1)), ("a", t(2)), ("b", t(2)), ("a", t(10)), ("a", t(11))], schema).coalesce(1).write.parquet(str(src))
    out = limits.limited(spark.readStream.schema(schema).parquet(str(src)), "k", "ts", 2, 10)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["k"], r["ts"].second, r["ok"]) for r in spark.table("limited").collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 10, True), ("a", 11, True), ("b", 2, True)]


def test_upsert_by_batches(spark, tmp_path):
    path = str(tmp_path / "u")
    put = counters.upsert("id", path)
    put(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0)
    put(spark.createDataFrame([(2, "c")], "id int, v string"), 1)
    put(spark.createDataFrame([(2, "c")], "id int, v string"), 1)
    assert rows(counters.latest(spark.read.parquet(path), "id")) == [(1, "a"), (2, "c")]


def test_current_files(spark):
    files = spark.createDataFrame([("a", "new/a"), ("a", "old/a"), ("b", "old/b")], "document string, path string")
    manifest = spark.createDataFrame([("a", "new/a"), ("b", "new/b")], "document string, path string")
    assert rows(C.current_files(files, manifest).select("document", "path")) == [("a", "new/a")]
    with pytest.raises(Exception, match="listed more than once"):
        C.current_files(files, None).collect()
    with pytest.raises(Exception, match="listed more than once"):
        C.current_files(files, manifest.union(manifest)).collect()
