"""Overrides, finalisation, revisions, snapshots and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

KEY = ["assessment_id", "question_id"]


def canonical(value: Column, type_: DataType) -> Column:
    """``value`` with the fields of its structs in the order of their names and the keys of its maps in order, at every depth.

    Lists keep their order. The form is built from the schema, so it costs one expression, whatever the data.
    """
    if isinstance(type_, StructType):
        fields = sorted(type_.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(type_, ArrayType):
        return F.transform(value, lambda v: canonical(v, type_.elementType))
    if isinstance(type_, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], type_.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    return value


def canonical_json(rows: DataFrame, *columns: str) -> Column:
    """The columns of ``rows`` as one JSON object in canonical form; nulls are written."""
    parts = {f.name: f.dataType for f in rows.select(*columns).schema.fields}
    return F.to_json(F.struct(*(canonical(F.col(c), parts[c]).alias(c) for c in sorted(parts))), {"ignoreNullFields": "false"})


def canonical_hash(rows: DataFrame, *columns: str) -> Column:
    """SHA-256 of ``canonical_json``: payloads that differ in the order of fields or keys only, at any depth, hash alike."""
    return F.sha2(canonical_json(rows, *columns).cast("binary"), 256)


def typed_events(events: DataFrame, *payloads: str) -> DataFrame:
    """Audit events whose payload columns, JSON texts of any shape, become VARIANT; what is no JSON is null, its text in <name>_text."""
    kept = {f"{c}_text": F.when(F.try_parse_json(c).isNull(), F.col(c)) for c in payloads}
    return events.withColumns(kept | {c: F.try_parse_json(F.col(c)) for c in payloads})


def payload_kind(value: Column) -> Column:
    """What a payload is: object, list, number, boolean, text, null, or none where there is no payload."""
    name = F.schema_of_variant(value)
    return (F.when(value.isNull(), "none").when(F.is_variant_null(value), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "list").when(name == "BOOLEAN", "boolean")
            .when(name == "STRING", "text").otherwise("number"))


def payload_at(value: Column, path: str, type_: str) -> Column:
    """What stands at a path of a payload, as a type; null where there is nothing or something else."""
    return F.try_variant_get(value, path, type_)


def validate_overrides(events: DataFrame, results: DataFrame) -> DataFrame:
    """Override events with reason; null for a valid one. criterion_sum is null where criteria weren't given."""
    rows = events.join(results.select(*KEY, "max_marks"), KEY, "left")
    reason = (F.when(F.col("max_marks").isNull(), "unknown_question").when(F.col("teacher_marks").isNull(), "no_marks").when(F.col("teacher_marks") < 0, "negative_marks").when(F.col("teacher_marks") > F.col("max_marks"), "above_maximum")
              .when(F.abs(F.col("criterion_sum") - F.col("teacher_marks")) > F.lit(0.05).cast("decimal(4,2)"), "criteria_do_not_add_up"))
    return rows.withColumn("reason", reason).select(*events.columns, "reason")


def apply_criterion_overrides(criteria: DataFrame, overrides: DataFrame) -> DataFrame:
    """Criteria with a teacher's marks and the status that those imply. overrides: keys, criterion_id, marks."""
    rows = criteria.join(overrides.select(*KEY, "criterion_id", "marks"), [*KEY, "criterion_id"], "left")
    status = F.when(F.col("marks").isNull(), F.col("status")).when(F.col("marks") >= F.col("max_marks"), "present").when(F.col("marks") > 0, "partially_present").otherwise("missing")
    return rows.withColumns({"status": status, "awarded_marks": F.coalesce("marks", F.col("awarded_marks"))}).select(criteria.columns)


def latest_overrides(valid: DataFrame) -> DataFrame:
    """The last valid override of each question; of equal times the larger event id."""
    return valid.where("reason is null").groupBy(*KEY).agg(F.max(F.struct("ts", "event_id", "teacher_marks")).alias("last")).select(*KEY, "last.ts", "last.event_id", "last.teacher_marks")


def apply_overrides(results: DataFrame, valid: DataFrame) -> DataFrame:
    """Results after overrides. AI marks never change."""
    rows = results.join(latest_overrides(valid).select(*KEY, "teacher_marks"), KEY, "left")
    changed = F.col("teacher_marks").isNotNull()
    return rows.withColumns({"teacher_adjusted_marks": F.coalesce("teacher_marks", "teacher_adjusted_marks"), "awarded_marks": F.coalesce("teacher_marks", "awarded_marks"), "review_status": F.when(changed, "TEACHER_OVERRIDE").otherwise(F.col("review_status")), "needs_review": F.when(changed, False).otherwise(F.col("needs_review"))}).select(results.columns)


def override_audit(valid: DataFrame, results: DataFrame) -> DataFrame:
    """An audit row for each valid override: the marks before (the AI's at first) and after."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    rows = valid.where("reason is null").join(results.select(*KEY, "original_ai_marks"), KEY)
    return rows.select("event_id", *KEY, "ts", F.lit("TEACHER_OVERRIDE").alias("event_type"), F.coalesce(F.lag("teacher_marks").over(w), "original_ai_marks").alias("previous_value"), F.col("teacher_marks").alias("new_value"))


def finalize(totals: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finalised assessments with their revision, audit rows). events: assessment_id, ts, event_id; each is a revision."""
    w = Window.partitionBy("assessment_id").orderBy("ts", "event_id")
    numbered = events.select("assessment_id", "ts", "event_id", F.row_number().over(w).alias("revision_index"))
    last = numbered.groupBy("assessment_id").agg(F.max("revision_index").alias("revision_index"), F.max("ts").alias("finalized_at"))
    done = totals.join(last, "assessment_id").withColumn("assessment_status", F.lit("FINALIZED"))
    return done, numbered.select("event_id", "assessment_id", "ts", F.lit("FINALIZED").alias("event_type"), "revision_index")


def snapshots(done: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """payload and hash of each (assessment, revision) that ``known`` hasn't: a snapshot is never written again."""
    columns = [c for c in done.columns if c != "finalized_at"]
    rows = done.select("assessment_id", "revision_index", canonical_json(done, *columns).alias("payload"))
    rows = rows.withColumn("snapshot_hash", F.sha2(F.col("payload").cast("binary"), 256))
    return rows if known is None else rows.join(known.select("assessment_id", "revision_index"), ["assessment_id", "revision_index"], "left_anti")


def verify_snapshots(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(assessment, revision, problem): a payload that doesn't have its hash, or a snapshot that isn't there."""
    wrong = stored.where(F.sha2(F.col("payload").cast("binary"), 256) != F.col("snapshot_hash")).select("assessment_id", "revision_index", F.lit("hash_mismatch").alias("problem"))
    lost = expected.select("assessment_id", "revision_index").join(stored.select("assessment_id", "revision_index"), ["assessment_id", "revision_index"], "left_anti").withColumn("problem", F.lit("missing"))
    return wrong.union(lost)


def revision_history(stored: DataFrame) -> DataFrame:
    w = Window.partitionBy("assessment_id").orderBy("revision_index")
    return stored.select("assessment_id", "revision_index", "snapshot_hash", F.lag("snapshot_hash").over(w).alias("previous_hash")).withColumn("changed", F.coalesce(F.col("snapshot_hash") != F.col("previous_hash"), F.lit(True)))


def snapshot_as_of(stored: DataFrame, current: DataFrame, wanted: DataFrame) -> DataFrame:
    """The payload of a wanted revision, else the current one. current: assessment_id, payload; wanted: assessment_id, revision_index."""
    rows = wanted.join(stored.select("assessment_id", "revision_index", F.col("payload").alias("kept")), ["assessment_id", "revision_index"], "left").join(current.select("assessment_id", F.col("payload").alias("now")), "assessment_id", "left")
    return rows.select("assessment_id", "revision_index", F.coalesce("kept", "now").alias("payload"), F.col("kept").isNotNull().alias("from_snapshot"))


def audit_trail(*parts: DataFrame) -> DataFrame:
    """Audit rows of all sources, in one table; ordered within each assessment."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("assessment_id").orderBy("ts", "event_id")
    return out.withColumn("sequence", F.row_number().over(w))
