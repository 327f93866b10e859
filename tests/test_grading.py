"""Literal fixtures of grading, matching and history."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillmark.operators import grading as G
from quillmark.operators import history as H
from quillmark.operators import matching as MT
from quillmark.operators import results as R
from quillmark.sources import ingest as I

CRITERIA = "assessment_id long, question_id string, criterion_id string, k int, description string, status string, confidence decimal(4,2), max_marks decimal(10,2), notes string"


def criteria(spark, *rows):
    return spark.createDataFrame([(1, "q", f"c{k}", k, f"topic {k}", s, D(c), D(m), n) for k, (s, c, m, n) in enumerate(rows)], CRITERIA)


def test_fusion(spark):
    local = criteria(spark, ("partially_present", "0.80", "1", None), ("present", "0.85", "1", None))
    proposed = spark.createDataFrame([(1, "q", "c0", "present", D("0.75")), (1, "q", "c1", "missing", D("0.90"))], "assessment_id long, question_id string, criterion_id string, status string, confidence decimal(4,2)")
    got = {r.criterion_id: (r.status, r.confidence, r.provenance) for r in G.fuse_evidence(local, proposed).collect()}
    assert got == {"c0": ("partially_present", D("0.60"), "conflict_flagged"), "c1": ("uncertain", D("0.40"), "conflict_flagged")}


def test_core_contradiction_zeroes(spark):
    got = G.score_questions(criteria(spark, ("present", "0.95", "2", None), ("contradicted", "0.9", "2", "Core contradiction identified"))).first()
    assert (got.awarded_marks, got.needs_review) == (D("0.00"), True)


@pytest.mark.parametrize(("status", "marks", "review"), [("present", "4.00", False), ("partially_present", "2.40", False), ("uncertain", "2.00", True), ("missing", "0.00", False), ("contradicted", "2.00", True)])
def test_credit(spark, status, marks, review):
    got = G.score_questions(criteria(spark, (status, "0.95", "4", None))).first()
    assert (got.awarded_marks, got.needs_review) == (D(marks), review)


def test_routing_budget(spark):
    q = spark.createDataFrame([(1, "q", False, "text", "explanation", False, 9, False)], "assessment_id long, question_id string, unanswered boolean, content_type string, answer_type string, has_diagram boolean, n_words int, has_regions boolean")
    c = criteria(spark, ("present", "0.95", "1", None))
    over = G.grading_route(q, c, F.lit(20)).first()
    assert (over.decision, over.reason) == ("REVIEW_REQUIRED", "document_llm_budget_exceeded")
    assert G.grading_route(q, c).first().reason == "complex_conceptual_paraphrasing"


def test_rubric_adds_up(spark):
    q = spark.createDataFrame([(1, "a", "Define inertia.", "", D("5"), None, None), (1, "b", "Name the SI unit of force.", "", D("0"), None, "newton"), (1, "c", "Discuss trees rivers and mountains near towns", "", D("10"), None, None)], "assessment_id long, question_id string, text string, section string, max_marks decimal(10,2), correct_option string, correct_answer string")
    specs = G.question_specs(q)
    kinds = {r.question_id: (r.expected_answer_type, r.resolved_marks) for r in specs.collect()}
    assert kinds == {"a": ("definition", D("5.00")), "b": ("one_word", D("2.00")), "c": ("long_conceptual", D("10.00"))}
    sums = {r.question_id: r.s for r in G.build_rubric(specs).groupBy("question_id").agg(F.sum("max_marks").alias("s")).collect()}
    assert sums == {"a": D("5.00"), "b": D("2.00"), "c": D("10.00")}


def test_answer_keys_and_numbers(spark):
    refs = [("Answer 3", "3"), ("Ans. 2(a)", "2(a)"), ("q.5", "5"), ("(4)", "4"), ("123e4567-e89b-12d3-a456-426614174000", None), (None, None), ("  ", None)]
    got = spark.createDataFrame(refs, "raw string, want string").withColumn("got", I.clean_answer_ref(F.col("raw"))).collect()
    assert [r.got for r in got] == [r.want for r in got]
    numbers = [("Q1", "1"), ("q. 5(a):", "5(a)"), ("", "9"), (None, "9"), ("123e4567-e89b-12d3-a456-426614174000", "9"), ("3.", "3")]
    got = spark.createDataFrame(numbers, "raw string, want string").withColumn("got", I.clean_question_number(F.col("raw"), F.lit(9))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_numeric(spark):
    cases = [("", "x", "", 0.0), ("it is 9.81", "q", "9.8", 1.0), ("x = 2 and 3", "solve x^2 - 5x + 6", "", 1.0), ("x=2", "solve x^2 - 5x + 6", "", 0.5), ("a = 1\nb = 2", "q", "", 0.85), ("about 4", "q", "77", 0.9), ("none", "q", "", 0.5)]
    got = spark.createDataFrame(cases, "a string, q string, key string, want double").withColumn("m", G.numeric_answer_score(F.col("q"), F.col("a"), F.col("key"))).select("want", "m.score").collect()
    assert [r.score for r in got] == [r.want for r in got]


def test_content_type(spark):
    cases = [("", "unknown"), ("(B)", "mcq_selection"), ("Q21. (A) A lens", "mcq_selection"), ("-3.5", "number"), ("def f(x): return x", "code"), ("a = b", "formula"), ("so a = b and then we get c", "mathematical_work"), ("two words", "short_text"), ("five plain words are here", "text")]
    got = spark.createDataFrame(cases, "t string, want string").withColumn("got", G.answer_content_type(F.col("t"), F.lit(False))).collect()
    assert [(r.t, r.got) for r in got] == cases


def test_weighted_score(spark):
    scores = dict(zip(("anchor", "semantic", "layout", "order", "type"), (F.lit(x).cast("decimal(6,3)") for x in (1.0, 0.123, 0.7, 1.0, 0.5)), strict=True))
    got = spark.range(1).select(MT.weighted_match_score(F.lit(True), scores, F.lit(False)).alias("s")).first().s
    assert got == D("0.667")


def test_similarity_ranks(spark):
    left = spark.createDataFrame([(1, "q", "Explain dropout regularization.")], "corpus_id long, id string, text string")
    right = spark.createDataFrame([(1, "a", "Dropout is a regularization that drops units."), (1, "b", "Rivers carry water.")], "corpus_id long, id string, text string")
    got = MT.lexical_similarity(left, right).collect()
    assert [r.right_id for r in got] == ["a"] and 0 < got[0].similarity < 1


RESULT = "assessment_id long, question_id string, ord int, question_number string, max_marks decimal(10,2), original_ai_marks decimal(10,2), teacher_adjusted_marks decimal(10,2), awarded_marks decimal(10,2), status string, evaluation_confidence decimal(4,2), needs_review boolean, review_status string, grading_provenance string"


def two_results(spark):
    return spark.createDataFrame([(1, "Q1", 1, "1", D("4"), D("3.5"), None, D("3.5"), "graded", D("0.9"), False, "NOT_REQUIRED", "local"), (1, "Q2", 2, "2", D("2"), D("0"), None, D("0"), "unanswered", D("0.95"), False, "NOT_REQUIRED", "local")], RESULT)


def test_totals_and_override(spark):
    r = two_results(spark)
    totals = R.assessment_totals(spark.createDataFrame([(1,), (2,)], "assessment_id long"), r).orderBy("assessment_id").collect()
    assert [(t.percentage, t.total_questions, t.performance_band) for t in totals] == [(D("58.33"), 2, "Developing"), (D("0.00"), 0, "Needs Support")]
    events = spark.createDataFrame([(1, "Q1", 1, 7, D("4"), None), (1, "Q1", 2, 8, D("5"), None), (1, "Q2", 1, 9, D("-1"), None), (1, "Q2", 1, 10, D("1.5"), D("2"))], "assessment_id long, question_id string, ts int, event_id long, teacher_marks decimal(10,2), criterion_sum decimal(10,2)")
    checked = H.validate_overrides(events, r)
    assert sorted((e.event_id, e.reason) for e in checked.collect()) == [(7, None), (8, "above_maximum"), (9, "negative_marks"), (10, "criteria_do_not_add_up")]
    after = {x.question_id: (x.original_ai_marks, x.awarded_marks) for x in H.apply_overrides(r, checked).collect()}
    assert after["Q1"] == (D("3.50"), D("4.00"))
    assert R.recalculated_totals(r).first().teacher_adjusted_marks is None


def test_snapshots_are_immutable(spark):
    done = two_results(spark).groupBy("assessment_id").agg(F.sum("awarded_marks").alias("marks")).withColumn("revision_index", F.lit(1))
    first = H.snapshots(done)
    assert first.count() == 1 and H.snapshots(done, first).count() == 0 and H.verify_snapshots(first, first).count() == 0
    assert H.verify_snapshots(first.withColumn("payload", F.lit("{}")), first).first().problem == "hash_mismatch"


def test_responses(spark):
    rows = spark.createDataFrame([("a", 1, '```json\n{"questions": [{"number": "Q1", "text": "x"}], "answers": []}\n```', "STOP"), ("b", 1, "nothing", "STOP"), ("c", 1, '{"questions": [{"number"', "STOP"), ("d", 1, None, None)], "document_id string, page int, response_text string, finish_reason string")
    got = {r.document_id: r.reason for r in I.read_model_responses(rows).collect()}
    assert got["a"] is None and got["b"] == got["d"] == "no_json" and got["c"] is not None
    assert [q.id for q in I.explode_questions(I.read_model_responses(rows)).collect()] == ["Q1"]


def test_explanations_are_written_after_the_shuffle(spark):
    """Sentences of each class in order, of ties too, without criteria that lack a part; one list is shuffled."""
    from quillmark.operators import results as R

    rows = [(1, "q", 2, "present", "b", 1.0, 2.0, None), (1, "q", 1, "present", "a", 0.5, 2.0, None), (1, "q", 1, "present", None, 0.5, 2.0, None), (1, "q", 3, "partially_present", "c", None, 2.0, "n"), (1, "q", 5, "contradicted", "d", 0.0, 2.0, None),
            (1, "q", 5, "missing", "e", 0.0, 2.0, "n"), (1, "q", 4, "contradicted", "f", 0.0, None, "why"), (1, "q", 6, "missing", "g", 0.0, None, "n"), (2, "q", 1, "uncertain", "h", 0.0, 2.0, "n"), (2, "q", 2, None, "h", 0.0, 2.0, "n")]
    criteria = spark.createDataFrame(rows, "assessment_id long, question_id string, k int, status string, description string, awarded_marks double, max_marks double, notes string")
    out = R.explain_questions(criteria)
    assert {r.assessment_id: tuple(r)[2:] for r in out.collect()} == {
        1: (["Satisfied criterion 'a' (0.5/2.0 marks)", "Satisfied criterion 'b' (1.0/2.0 marks)"], [], ["Contradiction identified in 'f' (why)", "Contradiction identified in 'd' (0 marks)", "Missing required concept 'e' (0/2.0 marks)"]),
        2: ([], [], [])}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_collect_list(") == 1 and "Satisfied" not in plan.split("partial_collect_list(")[1]


def test_insights_are_written_after_the_shuffle(spark):
    """As ``test_explanations_are_written_after_the_shuffle``."""
    from quillmark.operators import results as R

    rows = [(1, "q", "1", 2, "present", "b", "c2"), (1, "q", "1", 1, "present", "a", "c1"), (1, "q", "1", 1, "missing", None, "c0"), (1, "q", "1", 3, "uncertain", "c", None), (1, "q", "1", 4, None, "d", "c4"), (2, "q", "2", 1, "present", "a", "c1")]
    criteria = spark.createDataFrame(rows, "assessment_id long, question_id string, question_number string, k int, status string, description string, criterion_id string")
    results = spark.createDataFrame([(1, "q", "1", "graded", 0.5), (2, "q", "2", "unanswered", 0.5), (3, "q", "3", "graded", 0.5)], "assessment_id long, question_id string, question_number string, status string, evaluation_confidence double")
    out = R.question_insights(results, criteria)
    assert {r.assessment_id: tuple(r)[2:5] for r in out.collect()} == {
        1: (["Q1: Correctly demonstrated 'a'.", "Q1: Correctly demonstrated 'b'."], ["Q1: Evidence for 'c' is inconclusive and may require review."], ["q:q:c:c0", "q:q:c:c1", "q:q:c:c2", "q:q:c:c4"]),
        2: ([], ["Q2 was left unanswered."], ["q:q:unanswered"]), 3: ([], [], [])}
    assert out._jdf.queryExecution().sparkPlan().toString().count("partial_collect_list(") == 1
