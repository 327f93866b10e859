"""Sources and sinks: file manifests, blocks, model responses, results, snapshots, reports, request payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.steps import together
from quillmark.functions.text import UUID, has, strip

# Accepted file types and the largest size.
EXTENSIONS, MOST_BYTES = (".pdf", ".png", ".jpg", ".jpeg", ".docx"), 50 * 1024 * 1024
QUESTION_TYPES = ("MCQ", "SHORT_ANSWER", "LONG_ANSWER", "NUMERICAL", "TABLE", "DIAGRAM", "SUBQUESTION")

BBOX = "struct<x: double, y: double, width: double, height: double>"
BLOCKS = f"document_id string, id string, text string, confidence double, bbox {BBOX}, page int, type string, source string, modality string, role string"
ITEM = "number string, text string, question_number string, answer_text string, display_number string, num string, conf double, confidence double, max_marks string, question_type string, options array<string>, box_2d array<double>, bbox array<double>, ids array<string>, region_ids array<string>, src array<string>, source_ids array<string>, tgt array<string>, target_ids array<string>"
RESPONSE = f"questions array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in ITEM.split(', '))}>>, answers array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in ITEM.split(', '))}>>"


def file_verdict(name: Column, size: Column) -> Column:
    """struct(extension, reason); reason is null for an accepted file."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return F.struct(ext.alias("extension"), F.when(~ext.isin(*EXTENSIONS), "unsupported_extension").when(size > MOST_BYTES, "too_large").alias("reason"))


def scan_file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, extension, reason of every file below ``path`` that has any content; contents are not read.

    Spark's file sources leave out files of no bytes, which have nothing to transcribe."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("v", file_verdict(F.col("path"), F.col("length"))).select("path", "length", "v.extension", "v.reason")


def read_blocks(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Blocks of a fixed schema; what doesn't parse is kept in _corrupt_record."""
    reader = spark.read.schema(BLOCKS + (", _corrupt_record string" if format == "json" else ""))
    return (reader.option("mode", "PERMISSIVE") if format == "json" else reader).format(format).load(path)


def payload(text: Column) -> Column:
    """The outermost object (else array) of a model's text, without code fences."""
    bare = strip(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")))


def read_model_responses(responses: DataFrame, schema: str = RESPONSE) -> DataFrame:
    """responses (document_id, page, response_text, finish_reason) with parsed and reason; bad rows have a reason to go to quarantine."""
    body = payload(F.coalesce("response_text", F.lit("")))
    parsed = F.from_json(body, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = responses.withColumn("parsed", parsed)
    reason = F.when(body.isNull(), "no_json").when(F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull(), "invalid_json").when(F.coalesce("finish_reason", F.lit("")).isin("MAX_TOKENS", "LENGTH"), "truncated")
    return rows.withColumn("reason", reason)


def clean_question_number(raw: Column, index: Column) -> Column:
    """Blank or UUID: the 1-based fallback; one leading q and its dots go, trailing . : - go."""
    s = strip(F.coalesce(raw, F.lit("")))
    s = F.when(has(s, "^[qQ]"), F.regexp_replace(strip(F.substring(s, 2, 1 << 30)), r"^\.+", "")).otherwise(s)
    s = strip(F.regexp_replace(s, r"[.:\-]+$", ""))
    bad = (strip(F.coalesce(raw, F.lit(""))) == "") | has(strip(raw), UUID)
    return F.when(bad | (s == ""), index.cast("string")).otherwise(s)


def clean_answer_ref(raw: Column) -> Column:
    """The longest of answer/ans/q (with . or :) in front goes, then . : - and blanks around, then a lone pair of brackets. A UUID is null."""
    s = strip(F.coalesce(raw, F.lit("")))
    s = strip(F.regexp_replace(s, r"(?i)^(?:answer[.:]?|ans[.:]?|q[.:]?)\s*", ""))
    s = F.regexp_replace(s, r"^[.:\- ]+|[.:\- ]+$", "")
    s = F.when(has(s, r"^\([^(]*\)$"), strip(F.regexp_extract(s, r"^\(([^(]*)\)$", 1))).otherwise(s)
    return F.when(~has(strip(raw), UUID), F.nullif(s, F.lit("")))


def join_key(raw: Column) -> Column:
    return F.lower(clean_answer_ref(raw))


def normalized_box(box: Column, width: Column, height: Column, kind: str = "question") -> Column:
    """[ymin, xmin, ymax, xmax] in thousandths as pixels of one decimal; answers are clamped to the page and have a default."""
    y, x = box[0] / 1000 * height, box[1] / 1000 * width
    low = 5.0 if kind == "question" else 10.0
    h, w = F.greatest(F.lit(low), (box[2] - box[0]) / 1000 * height), F.greatest(F.lit(10.0), (box[3] - box[1]) / 1000 * width)
    ok = F.coalesce(F.size(box) == 4, F.lit(False))
    if kind == "answer":
        x, y, w, h = F.when(ok, x).otherwise(0.0), F.when(ok, y).otherwise(0.0), F.when(ok, w).otherwise(width * 0.7), F.when(ok, h).otherwise(50.0)
        x, y = F.greatest(F.lit(0.0), F.least(x, width - 1)), F.greatest(F.lit(0.0), F.least(y, height - 1))
        w, h = F.greatest(F.lit(10.0), F.least(w, width - x)), F.greatest(F.lit(10.0), F.least(h, height - y))
        ok = F.lit(True)
    one = lambda c: F.bround(c, 1)
    return F.when(ok, F.struct(one(x).alias("x"), one(y).alias("y"), one(w).alias("width"), one(h).alias("height")))


def xyxy_to_bbox(box: Column) -> Column:
    return F.struct(F.least(box[0], box[2]).alias("x"), F.least(box[1], box[3]).alias("y"), F.abs(box[2] - box[0]).alias("width"), F.abs(box[3] - box[1]).alias("height"))


def explode_questions(parsed: DataFrame) -> DataFrame:
    """A row for each question with text, its number cleaned, type and marks defaulted."""
    rows = parsed.where("reason is null").select("document_id", "page", F.posexplode("parsed.questions").alias("ord", "q"))
    number = clean_question_number(F.coalesce("q.number", "q.display_number", "q.num"), F.col("ord") + 1)
    kind, text = F.upper(strip(F.coalesce("q.question_type", F.lit("")))), strip(F.coalesce("q.text", F.lit("")))
    marks = F.coalesce(F.nullif(F.col("q.max_marks").try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")), F.lit(2).cast("decimal(10,2)"))
    return rows.select("document_id", "page", "ord", F.concat(F.lit("Q"), number).alias("id"), number.alias("number"), text.alias("text"), F.when(kind.isin(*QUESTION_TYPES), kind).otherwise("SHORT_ANSWER").alias("question_type"), marks.alias("max_marks"), F.coalesce("q.box_2d", "q.bbox").alias("box"), F.coalesce("q.confidence", "q.conf").alias("confidence")).where("text <> ''")


def explode_answers(parsed: DataFrame) -> DataFrame:
    """A row for each answer with text or a number."""
    rows = parsed.where("reason is null").select("document_id", "page", F.posexplode("parsed.answers").alias("ord", "a"))
    ref, text = clean_answer_ref(F.coalesce("a.question_number", "a.display_number", "a.num")), strip(F.coalesce("a.answer_text", "a.text", F.lit("")))
    return rows.select("document_id", "page", "ord", F.concat(F.lit("ans_vlm_p"), "page", F.lit("_"), "ord").alias("answer_id"), ref.alias("question_number"), text.alias("text"), F.coalesce("a.box_2d", "a.bbox").alias("box")).where("text <> '' or question_number is not null")


def write_results(results: DataFrame, path: str, partition: str = "ingest_date") -> None:
    """Overwrite the partitions that ``results`` has, and no others."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def report_rows(summaries: DataFrame, questions: DataFrame, revision: Column) -> DataFrame:
    """One nested row for each assessment and revision; questions are shuffled before they are collected."""
    rows = together(questions.select("assessment_id", "ord", "question_id", "question_number", "awarded_marks", "max_marks", "status"), "assessment_id")
    packed = rows.groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct("ord", "question_id", "question_number", "awarded_marks", "max_marks", "status"))).alias("questions"))
    return summaries.join(packed, "assessment_id", "left").withColumn("revision_index", revision)


def write_report(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def build_requests(routed: DataFrame, questions: DataFrame, answers: DataFrame, rubric: DataFrame) -> DataFrame:
    """JSON payloads of escalated questions, for an external evaluator."""
    asked = routed.where(F.col("decision").isin("LLM_REQUIRED", "LLM_RECOMMENDED")).select("assessment_id", "question_id", "reason")
    criteria = rubric.groupBy("assessment_id", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "criterion_id", "description", "max_marks"))), lambda c: F.struct(c["criterion_id"].alias("criterion_id"), c["description"].alias("description"), c["max_marks"].alias("max_marks"))).alias("criteria"))
    keys = ["assessment_id", "question_id"]
    rows = asked.join(questions.select(*keys, F.col("text").alias("question_text")), keys).join(answers.select(*keys, F.col("text").alias("student_answer")), keys, "left").join(criteria, keys, "left")
    return rows.select(*keys, F.to_json(F.struct("question_text", "student_answer", "reason", "criteria")).alias("payload"))


def region_manifest(regions: DataFrame) -> DataFrame:
    return regions.select("document_id", "region_id", "page", F.substring("text", 1, 60).alias("text"), "region_type", "confidence")
