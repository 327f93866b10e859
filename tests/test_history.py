"""Canonical forms, payloads of any shape, and the manifest of files."""

import hashlib
import json

from pyspark.sql import functions as F

from quillmark.operators import history as H
from quillmark.sources import ingest as I


def test_order_of_fields_and_keys_does_not_matter(spark):
    inner = {"b": [{"y": 1, "x": None}], "a": {"k2": {"q": 2, "p": 1}, "k1": {"q": 4, "p": 3}}}
    one = spark.createDataFrame([(1, inner, "t")], "id long, body struct<b: array<struct<y: int, x: string>>, a: map<string, struct<q: int, p: int>>>, name string")
    turned = {"a": {"k1": {"p": 3, "q": 4}, "k2": {"p": 1, "q": 2}}, "b": [{"x": None, "y": 1}]}
    two = spark.createDataFrame([("t", turned, 1)], "name string, body struct<a: map<string, struct<p: int, q: int>>, b: array<struct<x: string, y: int>>>, id long")
    want = json.dumps({"id": 1, "name": "t", "body": inner}, sort_keys=True, separators=(",", ":"))
    for rows in (one, two):
        got = rows.select(H.canonical_json(rows, "id", "name", "body").alias("json"), H.canonical_hash(rows, "body", "name", "id").alias("hash")).first()
        assert got.json == want and got.hash == hashlib.sha256(want.encode()).hexdigest()
    other = two.withColumn("id", F.lit(2).cast("long"))
    assert other.select(H.canonical_hash(other, "id", "name", "body").alias("h")).first().h != got.hash


def test_nulls_and_empty_parts_are_written(spark):
    rows = spark.createDataFrame([(None, [], {})], "s struct<b: int, a: int>, l array<struct<b: int, a: int>>, m map<string, int>")
    assert rows.select(H.canonical_json(rows, "s", "l", "m").alias("j")).first().j == '{"l":[],"m":{},"s":null}'


def test_payloads_of_any_shape(spark):
    texts = ['{"marks": {"final": 3.5}}', "[1, 2]", '"words"', "7", "true", "null", "no json", None, '{"marks": "all"}']
    rows = H.typed_events(spark.createDataFrame(list(enumerate(texts)), "event_id long, new_value string"), "new_value").orderBy("event_id")
    got = rows.select(H.payload_kind(F.col("new_value")).alias("kind"), H.payload_at(F.col("new_value"), "$.marks.final", "double").alias("final"), "new_value_text").collect()
    assert [r.kind for r in got] == ["object", "list", "text", "number", "boolean", "null", "none", "none", "object"]
    assert [r.final for r in got] == [3.5] + [None] * 8
    assert [r.new_value_text for r in got] == [None] * 6 + ["no json", None, None]


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, size in (("a.PDF", 10), ("b.exe", 3), ("c", 2), ("empty.pdf", 0), ("sub/d.docx", 7), ("sub/e.tar.png", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = I.scan_file_manifest(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.extension, r.reason) for r in files.collect()) == [
        ("a.PDF", 10, ".pdf", None), ("b.exe", 3, ".exe", "unsupported_extension"), ("c", 2, "", "unsupported_extension"), ("d.docx", 7, ".docx", None), ("e.tar.png", 1, ".png", None)]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.lower().replace("contents", "")
