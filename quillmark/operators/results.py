"""Totals, review queues, feedback and insights over question results. Every operator takes whole tables of many assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.steps import together
from quillmark.functions.text import mround, ordered

REASONS_LOW = 0.55
HIGH = 0.85


def performance_band(percentage: Column) -> Column:
    return F.when(percentage >= 90, "Outstanding").when(percentage >= 75, "Proficient").when(percentage >= 50, "Developing").otherwise("Needs Support")


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, mround(100 * part / whole)).otherwise(F.lit(0).cast("decimal(10,2)"))


def assessment_totals(assessments: DataFrame, results: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """One row for each assessment, also for one without questions (percentage 0)."""
    n = lambda c: F.count_if(c).alias
    sums = results.groupBy("assessment_id").agg(
        F.count("*").alias("total_questions"), n(F.col("status") != "unanswered")("answered_questions"), n(F.col("status") == "unanswered")("unanswered_questions"),
        F.sum("max_marks").alias("total_max"), F.sum("original_ai_marks").alias("ai_marks"), F.sum("awarded_marks").alias("final_marks"), F.sum("teacher_adjusted_marks").alias("teacher_marks"), F.avg("evaluation_confidence").alias("confidence"),
        n(F.col("needs_review") | F.col("review_status").isin("PENDING_REVIEW", "TEACHER_OVERRIDE"))("questions_needing_review"),
        n(F.col("grading_provenance") == "local")("local_only_questions"), n(F.col("grading_provenance").isin("local+llm", "llm"))("llm_assisted_questions"), n(F.col("grading_provenance") == "local_fallback")("fallback_questions"))
    out = assessments.select("assessment_id").join(sums, "assessment_id", "left")
    if unmatched is not None:
        out = out.join(unmatched.groupBy("assessment_id").agg(F.count("*").alias("unmatched_answers")), "assessment_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = [c for c in out.columns if c.endswith("questions") or c in ("questions_needing_review", "unmatched_answers")]
    marks = lambda c: zero(c).cast("decimal(10,2)").alias
    pct = percentage(zero("final_marks"), zero("total_max"))
    return out.select("assessment_id", *(zero(c).cast("long").alias(c) for c in counts), marks("total_max")("total_max_marks"), marks("ai_marks")("ai_awarded_marks"), F.col("teacher_marks").cast("decimal(10,2)").alias("teacher_adjusted_marks"), marks("final_marks")("final_awarded_marks"), pct.alias("percentage"), mround(zero("confidence")).alias("overall_confidence"), performance_band(pct).alias("performance_band"))


def recalculated_totals(results: DataFrame) -> DataFrame:
    """Marks after overrides; the teacher's total is null while nothing was overridden."""
    sums = results.groupBy("assessment_id").agg(F.sum("max_marks").alias("total"), F.sum(F.coalesce("teacher_adjusted_marks", "original_ai_marks")).alias("final"), F.count("teacher_adjusted_marks").alias("overrides"))
    return sums.select("assessment_id", F.when(F.col("overrides") > 0, F.col("final")).cast("decimal(10,2)").alias("teacher_adjusted_marks"), F.col("final").cast("decimal(10,2)").alias("final_awarded_marks"), percentage(F.col("final"), F.col("total")).alias("percentage"))


def review_reasons(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """question rows that are in the queue, with the first reason that applies."""
    flags = criteria.groupBy("assessment_id", "question_id").agg(F.bool_or(F.col("provenance") == "conflict_flagged").alias("conflict"), F.bool_or(F.col("status") == "contradicted").alias("contradicted"), F.bool_or(F.col("status") == "uncertain").alias("uncertain"))
    queue = results.where(F.col("needs_review") | F.col("review_status").isin("PENDING_REVIEW", "TEACHER_OVERRIDE")).join(flags, ["assessment_id", "question_id"], "left")
    reason = (F.when(F.col("status") == "review_required", "mapping_uncertainty").when(F.col("conflict"), "llm_disagreement").when(F.col("contradicted"), "contradiction").when(F.col("uncertain"), "uncertain_evidence")
              .when(F.col("evaluation_confidence") < REASONS_LOW, "low_confidence").otherwise(F.coalesce("escalation_reason", F.lit("teacher_requested_review"))))
    return queue.select("assessment_id", "question_id", "question_number", "max_marks", "awarded_marks", "evaluation_confidence", reason.alias("review_reason"), "review_status", F.col("teacher_adjusted_marks").isNotNull().alias("has_teacher_override"))


def review_breakdown(queue: DataFrame) -> DataFrame:
    """pending_count and the counts by reason of each assessment."""
    by_reason = queue.groupBy("assessment_id", "review_reason").agg(F.count("*").alias("n"))
    return by_reason.groupBy("assessment_id").agg(F.sum("n").alias("pending_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_reason", "n")))).alias("review_reasons_breakdown"))


FEEDBACK = (
    ("strengths", ("present",), "Demonstrated solid understanding of '", "'."),
    ("areas_to_improve", ("partially_present",), "Elaborate further on '", "' to earn full marks."),
    ("missing_concepts", ("missing",), "Missing required concept: '", "'."),
    ("corrections", ("contradicted",), "Incorrect/contradictory statement regarding '", "'."),
)


def question_feedback(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Evidence-grounded lists and text of each question; a default where no criterion says anything."""
    lists = [ordered(F.when(F.col("status").isin(*s), F.concat(F.lit(a), "description", F.lit(b))), "k").alias(name) for name, s, a, b in FEEDBACK]
    said = criteria.groupBy("assessment_id", "question_id").agg(*lists)
    none = F.array().cast("array<string>")
    out = results.select("assessment_id", "question_id", "status", "awarded_marks", "max_marks").join(said, ["assessment_id", "question_id"], "left")
    out = out.select("assessment_id", "question_id", "status", "awarded_marks", "max_marks", *(F.coalesce(name, none).alias(name) for name, *_ in FEEDBACK))
    silent = sum((F.size(name) for name, *_ in FEEDBACK), F.lit(0)) == 0
    missing = F.when(silent & (F.col("status") == "unanswered"), F.array(F.lit("No response submitted for this question."))).otherwise(F.col("missing_concepts"))
    strong = F.when(silent & (F.col("status") != "unanswered"), F.array(F.lit("Answer provided."))).otherwise(F.col("strengths"))
    out = out.withColumns({"missing_concepts": missing, "strengths": strong})
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f" {label}: "), F.array_join(c, " "))).otherwise("")
    text = F.concat(F.lit("Score: "), F.col("awarded_marks"), F.lit("/"), F.col("max_marks"), F.lit(". "), part("Strengths", "strengths"), part("Missing", "missing_concepts"), part("Improve", "areas_to_improve"), part("Corrections", "corrections"))
    return out.select("assessment_id", "question_id", *(name for name, *_ in FEEDBACK), F.trim(text).alias("feedback_text"))


def assessment_feedback(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Strong (at least .8 of the marks) and weak (at most .4) questions, and topics of the weak ones that lack evidence."""
    score = F.concat(F.lit("Q"), "question_number", F.lit(" ("), "awarded_marks", F.lit("/"), "max_marks", F.lit(")"))
    strong = F.col("awarded_marks") >= F.col("max_marks") * 0.8
    weak = ~strong & (F.col("awarded_marks") <= F.col("max_marks") * 0.4)
    base = results.groupBy("assessment_id").agg(F.slice(ordered(F.when(strong, F.concat(F.lit("Strong performance on "), score)), "ord", "question_id"), 1, 4).alias("strengths"), F.slice(ordered(F.when(weak, F.concat(F.lit("Needs improvement on "), score)), "ord", "question_id"), 1, 4).alias("areas_for_improvement"))
    lacking = criteria.where(F.col("status").isin("missing", "contradicted")).join(results.where(weak).select("assessment_id", "question_id"), ["assessment_id", "question_id"], "left_semi")
    topics = lacking.groupBy("assessment_id").agg(F.slice(ordered(F.concat(F.lit("Q"), "question_number", F.lit(": "), "description"), "ord", "question_id", "k"), 1, 5).alias("topics_requiring_attention"))
    return base.join(topics, "assessment_id", "left").withColumn("topics_requiring_attention", F.coalesce("topics_requiring_attention", F.array().cast("array<string>")))


def student_feedback(results: DataFrame, criteria: DataFrame, most: int = 6) -> DataFrame:
    """The first strengths, weaknesses and recommendations of an assessment; sentences are written after the shuffle."""
    s = F.col("status")
    kind = F.when(s == "present", 1).when(s.isin("missing", "contradicted"), 2).when(s == "partially_present", 3).cast("byte")
    named = lambda c: F.when(F.col("kind").isNotNull(), F.col(c)).alias(c)
    rows = criteria.withColumn("kind", kind).select("assessment_id", named("ord"), named("question_id"), named("k"), "kind", named("question_number"), named("description"))
    last = results.where("status = 'unanswered'").select("assessment_id", "ord", "question_id", F.lit(99).alias("k"), F.lit(4).cast("byte").alias("kind"), "question_number", F.lit(None).cast("string").alias("description"))
    some = together(rows.unionByName(last), "assessment_id")
    kind = F.col("kind")
    q = lambda *parts: F.concat(F.lit("Q"), "question_number", *(F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)))
    weakness = F.when(kind == 2, q(": Missing concept '", "description", "'.")).when(kind == 3, q(": Partial evidence for '", "description", "'.")).when(kind == 4, q(" was unanswered."))
    advice = (F.when(kind == 2, F.concat(F.lit("Review '"), "description", F.lit("' for Q"), "question_number", F.lit(" to strengthen core concept mastery."))).when(kind == 3, F.concat(F.lit("Elaborate further on '"), "description", F.lit("' in Q"), "question_number", F.lit(".")))
              .when(kind == 4, F.concat(F.lit("Ensure all questions are attempted, including Q"), "question_number", F.lit("."))))
    lists = {"strengths": F.when(kind == 1, q(": Mastered '", "description", "'.")), "weaknesses": weakness, "recommendations": advice}
    return some.groupBy("assessment_id").agg(*(F.slice(ordered(c, "ord", "question_id", "k"), 1, most).alias(name) for name, c in lists.items()))


PATTERNS = (("CONCEPTUAL_GAP", "missing"), ("PARTIAL_CONCEPT", "partially_present"), ("MISCONCEPTION", "contradicted"))


def question_insights(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Lists and references of each question; an unanswered one says only that.

    Criteria come together in one list, as in ``explain_questions``."""
    s = F.col("status")
    kind = F.when(s == "present", 1).when(s == "partially_present", 2).when(s.isin("missing", "contradicted"), 3).when(s == "uncertain", 4).cast("byte")
    some = criteria.withColumn("kind", kind).groupBy("assessment_id", "question_id").agg(F.collect_list(F.struct("k", "kind", "question_number", "description", "criterion_id")).alias("some"))
    q = lambda c, text, end: F.concat(F.lit("Q"), c["question_number"], F.lit(text), c["description"], F.lit(end))
    better = lambda c: F.when(c["kind"] == 2, q(c, ": Partial evidence for '", "'.")).when(c["kind"] == 3, q(c, ": Missing required concept '", "'.")).when(c["kind"] == 4, q(c, ": Evidence for '", "' is inconclusive and may require review."))

    def told(sentence):
        rows = F.filter(F.transform("some", lambda c: F.struct(c["k"].alias("k"), sentence(c).alias("value"))), lambda c: c["value"].isNotNull())
        return F.transform(F.array_sort(rows), lambda c: c["value"])

    said = some.select("assessment_id", "question_id", told(lambda c: F.when(c["kind"] == 1, q(c, ": Correctly demonstrated '", "'."))).alias("strengths"), told(better).alias("improvement_areas"), told(lambda c: F.concat(F.lit("q:"), F.col("question_id"), F.lit(":c:"), c["criterion_id"])).alias("evidence_refs"))
    rows = results.select("assessment_id", "question_id", "question_number", "status", "evaluation_confidence").join(said, ["assessment_id", "question_id"], "left")
    none, open_ = F.array().cast("array<string>"), F.col("status") == "unanswered"
    pick = lambda c, other: F.when(open_, other).otherwise(F.coalesce(c, none)).alias(c)
    return rows.select("assessment_id", "question_id", pick("strengths", none), pick("improvement_areas", F.array(F.concat(F.lit("Q"), "question_number", F.lit(" was left unanswered.")))), pick("evidence_refs", F.array(F.concat(F.lit("q:"), "question_id", F.lit(":unanswered")))), F.when(open_, F.lit(1)).otherwise(F.col("evaluation_confidence")).cast("decimal(4,2)").alias("confidence"))


def error_patterns(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Patterns of an assessment: recurring from two occurrences on. Criteria of unanswered questions don't count."""
    answered = criteria.join(results.where("status <> 'unanswered'").select("assessment_id", "question_id"), ["assessment_id", "question_id"], "left_semi")
    kind = F.lit(None).cast("string")
    for name, status in PATTERNS:
        kind = F.when(F.col("status") == status, name).otherwise(kind)
    seen = answered.select("assessment_id", kind.alias("pattern"), "question_id").where("pattern is not null")
    seen = seen.union(results.where("status = 'unanswered'").select("assessment_id", F.lit("UNANSWERED_PATTERN"), "question_id"))
    out = seen.groupBy("assessment_id", "pattern").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("question_id")).alias("question_ids"))
    return out.withColumn("title", F.concat(F.when(F.col("occurrences") >= 2, "Recurring pattern observed: ").otherwise("Observed issue: "), F.initcap(F.lower(F.replace("pattern", F.lit("_"), F.lit(" "))))))


def review_priorities(results: DataFrame) -> DataFrame:
    flagged = results.where("status <> 'unanswered' and (review_status <> 'NOT_REQUIRED' or needs_review)")
    text = F.concat(F.lit("Q"), "question_number", F.lit(" is flagged for teacher review (Status: "), "review_status", F.lit(", Confidence: "), F.bround(F.col("evaluation_confidence") * 100, 0).cast("int"), F.lit("%)."))
    return flagged.select("assessment_id", F.concat(F.lit("prio_"), "question_id").alias("insight_id"), text.alias("summary"), F.col("evaluation_confidence").alias("confidence"))


def question_summary(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Marks, percentage and criteria (nested, in order) of each question."""
    keys, parts = ("assessment_id", "question_id"), ("k", "criterion_id", "description", "max_marks", "status", "confidence")
    packed = together(criteria.select(*keys, *parts), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("criteria"))
    out = results.join(packed, ["assessment_id", "question_id"], "left")
    return out.select("assessment_id", "question_id", "max_marks", F.col("awarded_marks").alias("final_awarded_marks"), percentage(F.col("awarded_marks"), F.col("max_marks")).alias("percentage"), "status", "review_status", "criteria")


def confidence_bands(results: DataFrame) -> DataFrame:
    c = F.col("evaluation_confidence")
    return results.groupBy("assessment_id").agg(F.count_if(c >= HIGH).alias("high"), F.count_if((c >= 0.6) & (c < HIGH)).alias("medium"), F.count_if(c < 0.6).alias("low"))


def criterion_mastery(criteria: DataFrame) -> DataFrame:
    s = F.col("status")
    shares = {"present": s == "present", "partial": s == "partially_present", "missing": s.isin("missing", "contradicted")}
    return criteria.groupBy("assessment_id").agg(F.count("*").alias("criteria"), *(F.count_if(c).alias(f"n_{k}") for k, c in shares.items()), *(percentage(F.count_if(c), F.count("*")).alias(f"pct_{k}") for k, c in shares.items()))


def list_assessments(status: DataFrame, results: DataFrame) -> DataFrame:
    """The latest state of each assessment with counts by mapping status; without results, zeros."""
    counts = results.groupBy("assessment_id").agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "graded").alias("matched"), F.count_if(F.col("status") == "unanswered").alias("unanswered"), F.count_if(F.col("status") == "review_required").alias("review"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("questions", "matched", "unanswered", "review")]
    return status.select("assessment_id", "state").join(counts, "assessment_id", "left").select("assessment_id", "state", *zero)


TABS = {
    "NEEDS_REVIEW": "needs_review or review_status = 'PENDING_REVIEW'",
    "UNANSWERED": "status = 'unanswered'",
    "OVERRIDDEN": "review_status = 'TEACHER_OVERRIDE' or teacher_adjusted_marks is not null",
    "HIGH_CONFIDENCE": "evaluation_confidence >= 0.85 and not needs_review",
    "ALL": "true",
}


def question_filter(results: DataFrame, tab: str) -> DataFrame:
    return results.where(TABS[tab])


def question_search(questions: DataFrame, query: str, number: str = "number", text: str = "text") -> DataFrame:
    """Case-insensitive, literal substring of number or text."""
    q = F.lit(query.strip().lower())
    return questions.where(F.lower(number).contains(q) | F.lower(text).contains(q))


def attention_list(results: DataFrame) -> DataFrame:
    open_ = results.where("status = 'unanswered'").select("assessment_id", "question_id")
    return open_.union(results.where("status in ('review_required', 'unmatched') or needs_review").select("assessment_id", "question_id")).distinct()


def criterion_sum(criteria: DataFrame) -> DataFrame:
    """The sum of a question's criterion marks, at most its maximum; null if one of them isn't a number. marks is text."""
    number = F.expr("try_cast(marks as decimal(10,2))")
    sums = criteria.groupBy("assessment_id", "question_id").agg(F.bool_and(number.isNotNull()).alias("ok"), F.sum(number).alias("sum"), F.sum("max_marks").alias("most"))
    return sums.select("assessment_id", "question_id", F.when(F.col("ok"), F.least("sum", "most")).cast("decimal(10,2)").alias("marks"))


def first_messages(messages: DataFrame, most: int) -> DataFrame:
    """The first messages of each assessment, by order."""
    return messages.groupBy("assessment_id").agg(F.slice(ordered("message", "ord", "question_id", "k"), 1, most).alias("messages"))


def spanned_pages(regions: DataFrame) -> DataFrame:
    """The distinct pages of each answer in order, each with its neighbours. regions: assessment_id, answer_id, page."""
    from pyspark.sql import Window

    w = Window.partitionBy("assessment_id", "answer_id").orderBy("page")
    pages = regions.select("assessment_id", "answer_id", "page").distinct()
    return pages.select("assessment_id", "answer_id", "page", F.lag("page").over(w).alias("previous_page"), F.lead("page").over(w).alias("next_page"))


def explain_questions(criteria: DataFrame) -> DataFrame:
    """Explanation strings of each question by evidence class. criteria has awarded_marks.

    What the sentences are made of comes together in one list; they are written then, so that they aren't shuffled."""
    s = F.col("status")
    kind = F.when(s == "present", 1).when(s == "partially_present", 2).when(s == "missing", 3).when(s == "contradicted", 4).cast("byte")
    some = criteria.withColumn("kind", kind).groupBy("assessment_id", "question_id").agg(F.collect_list(F.when(
        F.col("kind").isNotNull(), F.struct("k", "kind", "description", F.when(F.col("kind") <= 2, F.col("awarded_marks")).alias("awarded"), F.when(F.col("kind") <= 3, F.col("max_marks")).alias("max"), F.when(F.col("kind") == 4, F.col("notes")).alias("notes")))).alias("some"))
    marks = lambda c: F.concat(F.lit("' ("), c["awarded"], F.lit("/"), c["max"], F.lit(" marks)"))
    say = lambda text, c, end: F.concat(F.lit(text), c["description"], end)

    def told(sentence, *kinds: int):
        rows = F.transform(F.filter("some", lambda c: c["kind"].isin(*kinds)), lambda c: F.struct(c["k"].alias("k"), sentence(c).alias("value")))
        return F.transform(F.array_sort(F.filter(rows, lambda c: c["value"].isNotNull())), lambda c: c["value"])

    lost = lambda c: F.when(c["kind"] == 3, say("Missing required concept '", c, F.concat(F.lit("' (0/"), c["max"], F.lit(" marks)")))).otherwise(say("Contradiction identified in '", c, F.concat(F.lit("' ("), F.coalesce(c["notes"], F.lit("0 marks")), F.lit(")"))))
    return some.select("assessment_id", "question_id", told(lambda c: say("Satisfied criterion '", c, marks(c)), 1).alias("strengths"), told(lambda c: say("Partial credit for '", c, marks(c)), 2).alias("partial_points"), told(lost, 3, 4).alias("missing_points"))
