"""Literal fixtures of regions, guards, anchors and geometry."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import graph as GR
from quillmark.operators import regions as RG

TYPES = [
    ("What", "UNKNOWN"), ("which", "UNKNOWN"), ("List", "UNKNOWN"), ("Why", "UNKNOWN"), ("1. What is photosynthesis?", "QUESTION"), ("Q2. Define inertia.", "QUESTION"), ("3) Water", "QUESTION"),
    ("(a) Explain the first law", "SUBQUESTION"), ("(A) Mitochondria", "OPTION"), ("B. Nucleus", "OPTION"), ("Note: all questions are compulsory", "INSTRUCTION"), ("SECTION A", "SECTION_HEADER"), ("plain words here", "UNKNOWN"),
]


def test_region_types(spark):
    rows = spark.createDataFrame(TYPES, "text string, want string")
    got = rows.withColumn("h", RG.classify_region(F.col("text"), F.lit(400.0), F.lit(30.0), F.lit(1000.0))).withColumn("r", RG.resolve_hypotheses(F.col("h"))).select("text", "want", "r.type").collect()
    assert [(r.text, r.type) for r in got] == [(r.text, r.want) for r in got]


PARENTS = [
    ("12. Attempt any two of these poems", True), ("Describe briefly the three rivers shown", True), ("Q 9) Give answers about the map below", True), ("The list below has these parts:", True),
    ("8. Name the longest river of the plain.", False), ("What does the second graph tell about rainfall?", False), ("Describe briefly " + "the route that the old traders took over the mountains " * 2, False), ("PART B", False),
]


def test_group_parents(spark):
    rows = spark.createDataFrame(PARENTS, "text string, want boolean").withColumn("got", RG.is_group_parent(F.col("text"))).collect()
    assert [(r.text, r.got) for r in rows] == PARENTS


def test_fragments(spark):
    rows = spark.createDataFrame([("(i)", True), ("(iv)", True), ("[a]", True), ("Q2", True), ("12.", True), ("1. What?", False), ("Sky", False), ("Mix", True)], "text string, want boolean").withColumn("got", RG.is_fragment(F.col("text"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


ANCHORS = [("Q12. (C) granite", "Q12"), ("6. (A) 40 km", "Q6"), ("Q5(d) Sketch the coast", "Q5(d)"), ("14(c). Name two rivers", "Q14(c)"), ("8 (B) sandstone", "Q8(b)"), ("a remark without a figure", None)]


def test_anchors(spark):
    rows = spark.createDataFrame(ANCHORS, "text string, want string").withColumn("got", RG.answer_anchor(F.col("text"))).collect()
    assert [(r.text, r.got) for r in rows] == ANCHORS


def test_display_numbers(spark):
    cases = [("Q1. Explain", "1"), ("1(a) Define", "1(a)"), ("a) Define", "1(a)"), ("(2) x", "2"), ("no number", "1")]
    rows = spark.createDataFrame(cases, "text string, want string").withColumn("got", RG.display_number(F.col("text"))).collect()
    assert [(r.text, r.got) for r in rows] == cases


def ground(spark, regions, box):
    r = spark.createDataFrame([("d", 1, i, t, *b) for i, t, b in regions], "document_id string, page int, region_id string, text string, x double, y double, width double, height double")
    b = spark.createDataFrame([("d", 1, "s", *box)], "document_id string, page int, box_id string, x double, y double, width double, height double")
    return RG.ground_boxes(b, r).first()


@pytest.mark.parametrize(
    ("regions", "box", "ids", "status"),
    [
        ([("b1", "one", (100.0, 100.0, 200.0, 30.0))], (100.0, 100.0, 200.0, 30.0), ["b1"], "GROUNDED"),
        ([(f"b{i}", "x", (100.0, y, 200.0, 20.0)) for i, y in enumerate((100.0, 125.0, 150.0))], (100.0, 100.0, 200.0, 80.0), ["b0", "b1", "b2"], "GROUNDED"),
        ([("b1", "one", (100.0, 100.0, 200.0, 30.0))], (299.0, 129.0, 100.0, 30.0), [], "UNGROUNDED"),
        ([], (0.0, 0.0, 10.0, 10.0), [], "UNGROUNDED"),
    ],
)
def test_grounding(spark, regions, box, ids, status):
    got = ground(spark, regions, box)
    assert (got.region_ids, got.status) == (ids, status)


def test_page_authority(spark):
    columns = "document_id string, region_id string, page int, role string, confidence double, state string"
    nodes = spark.createDataFrame([("d", "r1", 1, "QUESTION", 0.8, "UNVERIFIED"), ("d", "r2", 1, "QUESTION", 0.9, "VERIFIED")], columns)
    pages = spark.createDataFrame([("d", 1, "COMPLETE")], "document_id string, page int, completeness string")
    claims = spark.createDataFrame([("d", "r2")], "document_id string, region_id string")
    got = {r.region_id: (r.role, r.confidence, r.state) for r in GR.demote_unclaimed(nodes, pages, claims).collect()}
    assert got == {"r1": ("UNKNOWN", 0.4, "UNVERIFIED"), "r2": ("QUESTION", 0.9, "VERIFIED")}


def test_completeness(spark):
    pages = spark.createDataFrame([("a", 1, "MAX_TOKENS"), ("b", 1, "STOP"), ("c", 1, "SAFETY"), ("e", 1, "STOP")], "document_id string, page int, finish_reason string")
    structures = spark.createDataFrame([("a", 1, "QUESTION"), ("c", 1, "QUESTION"), ("e", 1, "QUESTION")], "document_id string, page int, role string")
    assert {r.document_id: r.completeness for r in GR.semantic_completeness(structures, pages).collect()} == {"a": "PARTIAL", "b": "FAILED", "c": "AMBIGUOUS", "e": "COMPLETE"}


@pytest.mark.parametrize(("kind", "edges"), [("QUESTION", 0), ("UNKNOWN", 1)])
def test_cross_page_continuation(spark, kind, edges):
    rows = [("d", 1, 0, "a", "1. Explain the", "QUESTION"), ("d", 2, 1, "b", "rest of it", kind)]
    got = RG.cross_page_continuation(spark.createDataFrame(rows, "document_id string, page int, ord int, region_id string, text string, region_type string"))
    assert got.count() == edges


def test_text_source(spark):
    cases = [("", "seen", "VLM_FALLBACK_EMPTY_OCR"), ("read", "", "OCR"), ("bcdfg hjklm", "an apple a day", "VLM_FALLBACK_GARBLED_OCR"), ("the red apple fell", "what a lovely morning", "VLM_OVERRIDE_LOW_AGREEMENT"), ("the red apple", "the red apple", "OCR")]
    rows = spark.createDataFrame(cases, "ocr string, model string, want string").withColumn("c", RG.choose_text_source(F.col("ocr"), F.col("model"))).select("want", "c.source").collect()
    assert [r.source for r in rows] == [r.want for r in rows]


def test_stitch(spark):
    schema = "document_id string, page int, ord int, role string, region_ids array<string>, display_number string, x double, y double, width double, height double, confidence double, mid_y double"
    top = spark.createDataFrame([("d", 1, 0, "QUESTION", ["t1"], "1", 0.0, 460.0, 300.0, 40.0, 0.8, 500.0)], schema)
    bottom = spark.createDataFrame([("d", 1, 0, "QUESTION", ["b1"], None, 0.0, 5.0, 320.0, 30.0, 0.9, 500.0), ("d", 1, 1, "QUESTION", ["b2"], "2", 0.0, 300.0, 300.0, 40.0, 0.9, 500.0)], schema)
    whole, remap = GR.stitch_split_pages(top, bottom)
    got = sorted((r.region_ids, r.y, r.height, r.confidence) for r in whole.collect())
    assert got == [(["b2"], 800.0, 40.0, 0.9), (["t1", "b1"], 460.0, 75.0, 0.9)]
    edges = spark.createDataFrame([("d", "b1", "t1", "follows", 0.5), ("d", "x", "b1", "option_of", 0.5), ("d", "x", "t1", "option_of", 0.7)], "document_id string, source_id string, target_id string, relationship string, confidence double")
    assert [(r.source_id, r.target_id, r.confidence) for r in GR.remap_edges(edges, remap).collect()] == [("x", "t1", 0.7)]
