"""What a query's plan works out, and how often: costs that its results don't show."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.functions.text import strip
from quillmark.operators import grading as G
from quillmark.operators import matching as MT
from quillmark.plans.registry import QUERIES
from quillmark.sources import ingest as I

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_strip_is_of_unicode_white_space(spark):
    ends = [chr(c) for c in [*range(0x00, 0x3100), 0xFEFF, 0x1F600] if c not in range(0xD800, 0xE000)]
    rows = spark.createDataFrame([(i, t) for c in ends for i, t in enumerate((c, f"{c}a{c}b{c}", f" {c}\n a b{c} \r\n", f"a{c}"))], "i int, t string").union(spark.createDataFrame([(9, None), (9, "")], "i int, t string"))
    assert rows.where(~strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_texts_are_chosen_by_letters_taken_once(spark):
    """o and m each lose what isn't a letter once; in the branches of a CASE it was done again and again."""
    assert plan(spark, "p15_choose_text_source").count(r"[^\p{L}]") == 2


def test_regions_are_classified_once(spark):
    """The filter that Spark infers from an explode isn't a second classification."""
    for name in ("p16_classify_region", "j13_fuse_region_hypotheses", "a23_verification_summary"):
        assert plan(spark, name).count("Maximum Marks") == 1


def test_pages_are_folded_once(spark):
    """both halves come from one fold, which isn't repeated in filters or for each bottom structure."""
    for name in ("j19_stitch_split_pages", "j19_orphan_edges"):
        assert len(re.findall(r"aggregate\((?:coalesce\()?tops", plan(spark, name))) == 1
    assert len(re.findall(r"aggregate\(all", plan(spark, "j7_claim_regions"))) == 1


def test_lists_are_collected_after_the_shuffle(spark):
    """No task sorts what it reads to collect lists of it before it shuffles."""
    for name in ("a1_score_question", "a9_student_feedback", "a13_question_summary", "p27_canonical_hash", "p29_grading_feedback"):
        before = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")
        assert len(before) == 2 and "collect_list" not in before[1]


def test_all_pairs_of_a_block_are_bounded():
    """a task that returns all pairs holds a million of them, in arrays."""
    rng = np.random.default_rng(5)
    side = lambda n: pa.table({"corpus_id": ["c"] * n, "id": np.arange(n), "v": list(rng.random((n, 8)))})
    left, right = side(MT.ALL_LEFT), side(MT.ALL_RIGHT)
    tracemalloc.start()
    pairs = MT.compared(None, True, None)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs.num_rows == MT.ALL_LEFT * MT.ALL_RIGHT - MT.ALL_LEFT and peak < 150e6


def test_grading_reads_written_parts(spark):
    """the patterns of questions aren't matched again for each reading of them."""
    assert r"\b(diagram|sketch|draw|figure" not in plan(spark, "p25_grading_route")


def test_proposals_are_validated_by_the_join_that_fuses(spark):
    """criteria are shuffled once, not once more to validate proposals; repeated and unknown criteria and null keys come out as before."""
    executed = QUERIES["j11_fuse_evidence"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 2 == executed.count("REPARTITION_BY_NUM")
    keys = [(1, "a", "c1"), (1, "a", "c1"), (1, "a", "c2"), (2, "a", "c1"), (None, "a", "c1"), (3, None, "c1"), (3, "b", "c3")]
    local = spark.createDataFrame([(*k, i, f"d{i}", "m", ["missing", "present", "uncertain"][i % 3]) for i, k in enumerate(keys)], "assessment_id long, question_id string, criterion_id string, k int, description string, notes string, status string").selectExpr("*", "cast(2 as decimal(10,2)) as max_marks", "cast(0.6 as decimal(4,2)) as confidence")
    offers = [(*k, s, c) for k, s, c in zip([*keys[1:], (9, "x", "c1")], ["Present", None, "odd", "contradicted", "present", "missing", "present"], [0.9, None, 7.0, -1.0, 0.8, 0.5, 0.5], strict=True)]
    proposed = spark.createDataFrame([(*o, "e") for o in [*offers, offers[0]]], "assessment_id long, question_id string, criterion_id string, status string, confidence double, evidence string")
    got = sorted(G.fuse_proposals(local, proposed).collect(), key=str)
    assert got == sorted(G.fuse_evidence(local, G.validate_proposed_evidence(proposed, local)).collect(), key=str) and len(got) == 13


def test_reports_are_collected_after_the_shuffle(spark):
    """no task sorts the questions it reads to collect lists of them before it shuffles."""
    rows = spark.createDataFrame([(i % 3, i, f"q{i}", str(i), 1, 2, "graded", "not in a report") for i in range(9)], "assessment_id long, ord int, question_id string, question_number string, awarded_marks int, max_marks int, status string, more string")
    reports = I.report_rows(rows.select("assessment_id").distinct(), rows, F.lit(1))
    before = reports._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")
    assert len(before) == 2 and "collect_list" not in before[1]
    assert {r.assessment_id: [q.ord for q in r.questions] for r in reports.collect()} == {0: [0, 3, 6], 1: [1, 4, 7], 2: [2, 5, 8]}
