"""The pipeline's stages keep what they should, whole and in order."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34", "en", "s", 5), (900_003, "a clean line of words that nothing else has, honestly", "en", "s", 52)], docs.schema)
    docs, sizes = docs.union(extra), []
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, docs, DIR), name)
        assert out.columns == docs.columns
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append((name, docs.count(), out.count()))
        docs = out
    assert sizes[0][1] - sizes[0][2] == 2
    assert docs.where("doc_id = 900003").count() == 1
    packed = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_and_names(spark):
    assert pipeline.run(spark, DIR).count() > 0
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "packing"]


def test_rows_that_repeat_or_lack_an_id(spark):
    """What is said of a text holds for its rows alone; no rows: none."""
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = "a clean line of words that nothing else has, honestly"
    rows = [(None, f"before {item} after", "en", "s", 0), (None, good, "en", "s", 0), (None, "12 34", "en", "s", 0), (950_001, "12 34", "en", "s", 0), (950_001, good, "en", "s", 0), (950_002, item, "en", "s", 0), (950_002, None, "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    told = {(r.doc_id, r.text) for r in pipeline.language_stage(spark, docs, DIR).where("doc_id is null or doc_id > 950000").collect()}
    assert told == {(None, rows[0][1]), (None, good), (950_001, good), (950_002, item)}
    left = {(r.doc_id, r.text) for r in pipeline.benchmark_stage(spark, docs, DIR).where("doc_id is null or doc_id > 950000").collect()}
    assert left == {(None, good), (None, "12 34"), (950_001, "12 34"), (950_001, good), (950_002, None)}
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_copies_go_row_by_row(spark):
    """Rows that share a doc_id, lack one or repeat whole: one row of each group of copies stays, a different text too."""
    copy, good = "the words of one text that several rows have in common " * 3, "a clean line of words that nothing else has, honestly"
    rows = [(1, copy), (5, copy), (5, good), (None, copy), (7, copy), (7, copy), (8, None), (8, None), (8, ""), (None, "only rows without an id say this here"), (None, "only rows without an id say this here")]
    schema = "doc_id long, text string, row string, number int, place string, component_id string"
    docs = spark.createDataFrame([(*r, "r", i, "p", "c") for i, r in enumerate(rows)], schema).repartition(3)
    kept = pipeline.near_copy_stage(spark, docs, DIR)
    assert kept.columns == docs.columns
    got = sorted((tuple(r) for r in kept.select("doc_id", "text").collect()), key=str)
    assert got == sorted([(1, copy), (5, good), (8, None), (8, None), (8, ""), (None, rows[9][1])], key=str)
    assert kept.where("row = 'r' and place = 'p' and component_id = 'c'").count() == 6


def test_language_stage_leaves_rows_in_place(spark):
    """No row is shuffled to be judged, and columns named like verdicts come through."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumnsRenamed({"source": "lang_pred", "n_chars": "score"})
    out = pipeline.language_stage(spark, docs, DIR)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    same = pipeline.language_stage(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect()))
