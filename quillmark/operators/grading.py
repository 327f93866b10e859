"""Specifications, rubrics, local evidence, routing, fusion and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.steps import together
from quillmark.functions.text import col, has, lit_list, mround, ordered, strip, words

# Number words, section marks, stop words and the patterns of the ordered classifiers.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
STOP_WORDS = ("what", "when", "where", "which", "who", "why", "how", "define", "explain", "differentiate", "between", "mention", "major", "functions", "given", "write", "state", "using", "with", "suitable", "question", "marks", "answer", "find", "show", "calculate", "identify", "describe", "detail", "help", "example")
DESCRIPTION_STOP_WORDS = ("provides", "explains", "correct", "option", "uses", "technical", "terminology", "related", "defines", "core", "concept")
DIAGRAM = r"\b(diagram|sketch|draw|figure|flowchart|architecture|visual)\b"
MATH_WORDS = r"\b(calculate|compute|solve|derive|equation|formula|evaluate|find the value|matrix|integral)\b"
MATH_SIGNS = r"[=+\-*/^√∫]"
CODE = r"\b(code|program|python|function|algorithm|implement|script|class|java|c\+\+)\b"
FACT = r"\b(unit of|si unit|name|state|what is the output of|which|who|where|formula of|symbol of|value of)\b"
NUMBER = r"[-+]?\d*\.?\d+"
CREDIT = {"present": 1.0, "partially_present": 0.6, "uncertain": 0.5, "missing": 0.0}
CONFIDENT, ROUTE_CONFIDENCE, CALL_BUDGET, BATCH = 0.85, 0.75, 20, 18


def resolve_max_marks(text: Column, section: Column, given: Column) -> Column:
    """struct(max_marks, provenance): the given marks, else what the text or section says, else 2."""
    text, section = F.coalesce(text, F.lit("")), F.coalesce(section, F.lit(""))
    both, low = F.concat_ws(" ", section, text), F.lower(section)
    number = lambda c, p: F.regexp_extract(c, p, 1).try_cast("decimal(10,2)")
    direct = number(text, r"(?i)\[?\b(\d{1,2}(?:\.\d)?)\s*(?:marks?|m|pts?|points?)\b\]?")
    each = number(both, r"(?i)(?:each|per)\s+(?:question|item)?\s*(?:carries|is|of)?\s*(\d{1,2})\s*marks?")
    word = F.lower(F.regexp_extract(both, rf"(?i)\b({'|'.join(NUMBER_WORDS)})\s*marks?\b", 1))
    by_word = F.array_position(lit_list(NUMBER_WORDS), word).cast("decimal(10,2)")
    has_part = lambda a, *more: F.greatest(*(low.contains(x) for x in (a, *more))) if more else low.contains(a)
    by_part = F.when(has_part("section-a", "part-a", "part a"), 2).when(has_part("section-b", "part-b", "part b"), 5).when(has_part("section-c", "part-c", "part c"), 10).otherwise(2).cast("decimal(10,2)")
    found = F.coalesce(F.nullif(direct, F.lit(None)), each, F.nullif(by_word, F.lit(0).cast("decimal(10,2)")))
    return F.struct(F.coalesce(F.when(given > 0, given), found, by_part).cast("decimal(10,2)").alias("max_marks"), F.when(given > 0, "vlm_direct").when(found.isNotNull(), "high").otherwise("medium").alias("marks_confidence"))


def question_flags(text: Column) -> dict[str, Column]:
    low = F.lower(strip(text))
    return {"has_diagram": has(low, DIAGRAM), "has_math": has(low, MATH_WORDS) | has(strip(text), MATH_SIGNS), "has_code": has(low, CODE)}


def expected_answer_type(text: Column, n_options: Column, max_marks: Column) -> Column:
    """The first rule that fits, of fourteen."""
    t = strip(text)
    low, n, flag = F.lower(t), words(text), question_flags(text)
    any_of = lambda *xs: F.greatest(*(low.contains(x) for x in xs))
    return (
        F.when((n_options >= 2) | has(t, r"\([A-D]\)") | has(t, r"^\s*\(?[A-D]\)?\s*[.\-]"), "mcq")
        .when(has(low, FACT) & (n <= 15), "one_word")
        .when(has(low, r"\b(define|meaning of|what do you understand by)\b") | (has(low, r"\bwhat is\b") & (n <= 15) & ~has(low, r"\b(unit|formula|symbol|name|value)\b")), "definition")
        .when(flag["has_code"], "code").when(low.contains("algorithm"), "algorithm")
        .when(flag["has_math"] & any_of("derive", "proof"), "mathematical_derivation").when(flag["has_math"], "numerical")
        .when(flag["has_diagram"] & any_of("explain", "describe"), "diagram_explanation").when(flag["has_diagram"], "diagram")
        .when(has(low, r"\b(differentiate|compare|difference between|vs|versus)\b"), "comparison")
        .when(has(low, r"\b(steps|process|procedure|working of|how does)\b"), "process")
        .when((max_marks >= 7) | (n > 25) | any_of("with example", "in detail"), "long_conceptual")
        .when((max_marks <= 2) | (n <= 15), "short_conceptual").otherwise("explanation")
    )


def required_concepts(text: Column) -> Column:
    """Words of three letters or more, in order, once each, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])([a-zA-Z]{3,})(?![\p{L}\p{N}_])"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def question_specs(questions: DataFrame) -> DataFrame:
    """questions (text, section, max_marks; options or not) with type, flags, marks and concepts."""
    n_options = F.coalesce(F.size("options"), F.lit(0)) if "options" in questions.columns else F.lit(0)
    marks = resolve_max_marks(F.col("text"), F.col("section"), F.col("max_marks"))
    q = questions.withColumn("marks", marks)
    q = q.withColumns({"resolved_marks": F.col("marks.max_marks"), "marks_confidence": F.col("marks.marks_confidence"), "concepts": required_concepts(F.col("text")), **question_flags(F.col("text"))})
    return q.withColumn("expected_answer_type", expected_answer_type(F.col("text"), n_options, F.col("resolved_marks"))).drop("marks")


def answer_content_type(text: Column, has_regions: Column) -> Column:
    t, n = strip(F.coalesce(text, F.lit(""))), words(F.coalesce(text, F.lit("")))
    choice = has(t, r"^\s*\(?[A-Da-d]\)?\s*$") | has(t, r"(?i)^\s*(?:option|ans(?:wer)?)\s*[:.\-]?\s*\(?[A-Da-d]\)?\s*$") | has(t, r"^\s*(?:[Qq]?\d+[.)\-]?\s*)?\(?[A-Da-d]\)(?:[.:\-)]|\s+)") | has(t, r"^\s*[Qq]?\d+[.)\-]?\s*[A-Da-d][.:\-)]\s+")
    code = has(t, r"\b(def |class |import |for |while |return |public static|if __name__|std::)\b") | has(t, r"(?m)[{};]\s*$")
    math = has(t, r"[=+\-*/^√∫Σλπθ∂]|\\frac|\\sqrt")
    return (F.when(t == "", F.when(has_regions, "visual_only").otherwise("unknown")).when(choice, "mcq_selection").when(has(t, r"^\s*[+\-]?\d+(?:\.\d+)?\s*$"), "number").when(code, "code")
            .when(math & (n <= 5), "formula").when(math, "mathematical_work").when(n <= 4, "short_text").when(n >= 40, "long_text").otherwise("text"))


def option_label(text: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(text, r"\b([A-Da-d])\b", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\(([A-Da-d])\)", 1), F.lit("")), F.lit("")))


def strip_option_prefix(text: Column) -> Column:
    numbered = strip(F.regexp_replace(text, r"^\s*[Qq]?\d+[.)\-]?\s*", ""))
    return strip(F.regexp_replace(numbered, r"^\s*\(?[A-Da-d]\)?(?:[.:\-)]|\s+)", ""))


def option_letter(text: Column) -> Column:
    """The letter that an answer text names by itself: numbered or leading, after 'option', or within its first 25 characters."""
    t = strip(F.coalesce(text, F.lit("")))
    lead, named, early = r"(?s)^\s*(?:[Qq]?\d+[.)\-]?\s*)?\(?([A-Da-d])\)?(?:[.:\-)]|\s+|$)", r"(?is)\b(?:option|ans(?:wer)?|choice)\s*[:.\-]?\s*\(?([A-Da-d])\)?\b", r"\(?([A-Da-d])\)?"
    pick = lambda c, p: F.nullif(F.upper(F.regexp_extract(c, p, 1)), F.lit(""))
    return F.struct(F.coalesce(pick(t, lead), pick(t, named)).alias("named"), pick(F.substring(t, 1, 25), early).alias("early"), has(t, r"^[Aa] ").alias("weak_letter"))


def student_option_choice(answers: DataFrame, options: DataFrame) -> DataFrame:
    """answers (keys, text) with letter and weak_letter. options: keys, ord, text.

    Patterns 1 to 3 name a letter; else the first option whose body holds the text or is held by it; else the one most
    similar (token Jaccard of at least .4); else any letter early in the text.
    """
    keys = [c for c in ("assessment_id", "question_id") if c in options.columns]
    own = answers.withColumn("found", option_letter(F.col("text")))
    body = options.select(*keys, "ord", option_label(F.col("text")).alias("option"), F.lower(strip_option_prefix(F.col("text"))).alias("body")).where("body <> ''")
    low = F.lower(strip(F.col("text")))
    tried = own.where("found.named is null and text is not null").join(body, keys).withColumn("low", low)
    held = (F.length("body") > 3) & (F.col("low").contains(F.col("body")) | F.col("body").contains(F.col("low")))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    similar = F.size(F.array_intersect(tokens("low"), tokens("body"))) / F.greatest(F.lit(1), F.size(F.array_union(tokens("low"), tokens("body"))))
    scored = tried.withColumns({"rank": F.when(held, 2.0).otherwise(similar)}).where("rank >= 0.4")
    best = scored.groupBy(*keys).agg(F.max_by("option", F.struct("rank", -F.col("ord"))).alias("by_body"))
    return own.join(best, keys, "left").select(*answers.columns, F.coalesce("found.named", "by_body", "found.early").alias("letter"), F.coalesce("found.weak_letter", F.lit(False)).alias("weak_letter"))


def contradiction_severity(description: Column, text: Column) -> Column:
    c, t = F.lower(description), F.lower(text)
    core = ((c.contains("dropout") | t.contains("dropout")) & t.contains("increase") & (t.contains("neuron") | t.contains("capacity"))) | ((c.contains("vanishing gradient") | c.contains("relu")) & t.contains("relu causes vanishing gradient"))
    return F.when(core, "core").when(t.contains("never") | t.contains("opposite") | t.contains("incorrectly"), "minor").otherwise("none")


def numeric_answer_score(question: Column, answer: Column, key: Column) -> Column:
    """struct(score, valid, confidence). Any number of the answer within max(0.01, 2 %) of any of the key; else what is there."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    numbers = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"({NUMBER})"), F.lit(1)), lambda x: x.try_cast("double"))
    close = F.exists(numbers(key), lambda t: F.exists(numbers(a), lambda s: F.abs(s - t) <= F.greatest(F.lit(0.01), F.abs(t) * 0.02)))
    square = q.contains("x^2 - 5x + 6") | q.contains("x^2-5x+6")
    two, three = a.contains("2"), a.contains("3")
    equations = F.size(F.filter(F.split(a, r"\r?\n"), lambda x: x.contains("=")))
    number = has(a, r"-?\d+(?:\.\d+)?")
    out = lambda s, v, c: F.struct(F.lit(s).cast("double").alias("score"), F.lit(v).alias("valid"), F.lit(c).cast("double").alias("confidence"))
    return (F.when(a == "", out(0, False, 0.9)).when(close, out(1, True, 0.98)).when(square & two & three, out(1, True, 0.95)).when(square & (two | three), out(0.5, True, 0.85))
            .when((equations >= 2) & number, out(0.85, True, 0.8)).when(equations >= 2, out(0.7, True, 0.8)).when(number, out(0.9, True, 0.85)).otherwise(out(0.5, True, 0.6)))


def code_answer_score(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    syntax, logic = has(t, r"\b(def|class|for|while|if|return|public|void)\b"), has(t, r"\b(return|print|output|yield|def|class)\b")
    return F.struct(F.when(t == "", 0.0).when(syntax & logic, 0.95).when(syntax | logic, 0.7).otherwise(0.5).alias("score"), F.when(t == "", 0.9).when(syntax, 0.85).otherwise(0.65).alias("confidence"))


def visual_answer_flag(regions: Column) -> Column:
    """regions: array of struct(page, bbox)."""
    area = F.aggregate(F.transform(regions, lambda r: r["bbox"]["width"] * r["bbox"]["height"]), F.lit(0.0), lambda a, x: a + x)
    none = F.coalesce(F.size(regions), F.lit(0)) <= 0
    return F.struct(F.when(none, "missing").otherwise("uncertain").alias("status"), F.when(none, 0.9).when(area > 500, 0.5).otherwise(0.4).alias("confidence"), (~none).alias("needs_review"))


def mcq_evidence(is_mcq: Column, unanswered: Column, key: Column, letter: Column) -> Column:
    """struct(status, confidence); null where the question isn't multiple choice or its key isn't known."""
    out = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    known = F.nullif(F.upper(strip(key)), F.lit(""))
    return F.when(is_mcq, F.when(unanswered, out("missing", 0.98)).when(known.isNull(), None).when(letter.isNull(), out("uncertain", 0.5)).when(letter == known, out("present", 0.98)).otherwise(out("missing", 0.98)))


def criterion_status(rows: DataFrame) -> DataFrame:
    """evidence_status and evidence_confidence of criterion rows: the first rule that decides.

    rows: description, answer_text, unanswered, mcq (struct or null), math (struct or null), visual (struct or null),
    correct_answer, key_points, answer_type, similarity.
    """
    text, low = strip(F.coalesce("answer_text", F.lit(""))), F.lower(strip(F.coalesce("answer_text", F.lit(""))))
    desc, n, sim = F.lower("description"), words(F.coalesce("answer_text", F.lit(""))), F.coalesce("similarity", F.lit(0.0))
    about = lambda *xs: F.greatest(*(desc.contains(x) for x in xs))
    terms = F.filter(F.transform(F.regexp_extract_all("description", F.lit(r"\b([a-zA-Z]{3,})\b"), F.lit(1)), F.lower), lambda w: ~w.isin(*DESCRIPTION_STOP_WORDS))
    word_match = F.exists(terms, lambda w: low.contains(w))
    key = F.lower(strip(F.coalesce("correct_answer", F.lit(""))))
    keyed = F.length(key) >= 2
    direct = low.contains(key) | (key.contains(low) & (F.length(low) >= 3)) | F.coalesce(F.exists("key_points", lambda k: (F.length(k) >= 3) & low.contains(F.lower(k))), F.lit(False))
    short_key = F.col("answer_type").isin("one_word", "mcq") | (words(key) <= 2)
    contra = contradiction_severity(F.col("description"), text)
    math_on = about("calculation", "formula", "numeric") & F.coalesce(F.col("math.valid"), F.lit(False))
    visual_on = about("diagram", "sketch", "visual") & (F.coalesce(F.col("visual.status"), F.lit("")) == "uncertain")
    full = ((n <= 4) & word_match) | (sim >= 0.30) | (word_match & (n >= 8))
    out = lambda s, c: F.struct(F.lit(s).alias("status"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    chosen = (
        F.when(F.col("mcq").isNotNull(), F.struct(F.col("mcq.status").alias("status"), F.col("mcq.confidence").cast("double").alias("confidence")))
        .when(F.col("unanswered"), out("missing", 0.95))
        .when(math_on & (F.col("math.score") >= 0.85), out("present", F.col("math.confidence"))).when(math_on & (F.col("math.score") >= 0.4), out("partially_present", F.col("math.confidence"))).when(math_on, out("missing", F.col("math.confidence")))
        .when(visual_on, out("uncertain", F.col("visual.confidence")))
        .when(keyed & direct, out("present", 0.96)).when(keyed & short_key & ~word_match, out("missing", 0.95))
        .when((text != "") & (contra != "none"), out("contradicted", 0.85))
        .when(full, out("present", F.least(F.lit(0.95), F.greatest(F.lit(0.75), F.when(n <= 4, 0.90).otherwise(sim + 0.35)))))
        .when((sim >= 0.20) | word_match, out("partially_present", 0.7)).when(F.length(text) < 5, out("missing", 0.9)).otherwise(out("missing", 0.85))
    )
    notes = F.when(F.col("chosen.status") == "contradicted", F.concat(F.lit("Contradiction detected ("), contra, F.lit(" severity)")))
    return rows.withColumn("chosen", chosen).withColumns({"evidence_status": F.col("chosen.status"), "evidence_confidence": F.col("chosen.confidence"), "evidence_notes": notes}).drop("chosen")


def grading_route(questions: DataFrame, criteria: DataFrame, calls: Column | None = None) -> DataFrame:
    """(decision, reason) of each question. questions: keys, unanswered, content_type, answer_type, has_diagram, n_words, has_regions."""
    flags = criteria.groupBy("assessment_id", "question_id").agg(F.bool_or(F.col("status") == "uncertain").alias("uncertain"), F.bool_or(F.col("status") == "contradicted").alias("contradicted"), F.bool_or(F.col("status") == "partially_present").alias("partial"), F.avg("confidence").alias("mean"))
    q = questions.join(flags, ["assessment_id", "question_id"], "left")
    calls = F.lit(0) if calls is None else calls
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    clear, wanted, needed = "LOCAL_CLEAR_WITH_HIGH_CONFIDENCE", "LLM_RECOMMENDED", "LLM_REQUIRED"
    fact = F.col("content_type").isin("mcq_selection", "number") | F.col("answer_type").isin("mcq", "one_word")
    deep = F.col("answer_type").isin("explanation", "long_conceptual", "short_conceptual", "process", "comparison", "definition") & (F.col("n_words") > 4)
    visual = (F.col("has_diagram") | F.col("content_type").isin("diagram", "visual_only")) & F.col("has_regions")
    route = (F.when(calls >= CALL_BUDGET, out("REVIEW_REQUIRED", "document_llm_budget_exceeded")).when(F.col("unanswered"), out(clear, "unanswered")).when(fact & F.col("uncertain"), out(wanted, "mcq_option_uncertain")).when(fact, out(clear, "clear_short_factual_or_mcq"))
             .when(visual, out(needed, "diagram_visual_understanding")).when(F.col("contradicted"), out(needed, "contradiction_severity_uncertain")).when(F.col("partial") | F.col("uncertain"), out(wanted, "semantic_ambiguity"))
             .when(deep, out(wanted, "complex_conceptual_paraphrasing")).when(F.coalesce("mean", F.lit(0)) < ROUTE_CONFIDENCE, out(needed, "local_confidence_low")).otherwise(out(clear, "local_evidence_high_confidence")))
    return q.withColumn("route", route).select(*questions.columns, F.col("route.decision").alias("decision"), F.col("route.reason").alias("reason"))


def call_budget(routed: DataFrame, most: int = CALL_BUDGET) -> DataFrame:
    """Escalations past the budget of an assessment, in question order, become REVIEW_REQUIRED."""
    asks = F.col("decision").isin("LLM_REQUIRED", "LLM_RECOMMENDED")
    w = Window.partitionBy("assessment_id").orderBy("ord", "question_id").rowsBetween(Window.unboundedPreceding, 0)
    over = asks & (F.count_if(asks).over(w) > most)
    return routed.withColumns({"reason": F.when(over, "document_llm_budget_exceeded").otherwise(F.col("reason")), "decision": F.when(over, "REVIEW_REQUIRED").otherwise(F.col("decision"))})


EVIDENCE_KEYS = ["assessment_id", "question_id", "criterion_id"]


def cleaned_proposals(proposed: DataFrame) -> DataFrame:
    """Proposals with a known status, a confidence from 0 to 1 and a bounded text; marks are never read."""
    status = F.lower("status")
    status = F.when(status.isin("present", "partially_present", "missing", "contradicted", "uncertain"), status).otherwise("uncertain")
    evidence = F.substring(F.coalesce("evidence", F.lit("")), 1, 150)
    return proposed.select(*EVIDENCE_KEYS, status.alias("status"), F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce("confidence", F.lit(0.7)))).cast("decimal(4,2)").alias("confidence"), F.nullif(evidence, F.lit("")).alias("evidence_text"))


def validate_proposed_evidence(proposed: DataFrame, rubric: DataFrame) -> DataFrame:
    """Proposals for criteria that exist, cleaned."""
    notes = F.when(F.col("status") != "contradicted", F.concat(F.lit("LLM evidence interpretation (status="), "status", F.lit(")"))).when(F.lower(F.coalesce("evidence_text", F.lit(""))).contains("core"), "Core contradiction identified by LLM evidence").otherwise("Minor contradiction identified by LLM evidence")
    return cleaned_proposals(proposed).join(rubric.select(*EVIDENCE_KEYS, "description", "max_marks"), EVIDENCE_KEYS).withColumn("notes", notes)


def fuse_evidence(local: DataFrame, proposed: DataFrame) -> DataFrame:
    """Local evidence with what a validated proposal changes of it."""
    p = proposed.select(*EVIDENCE_KEYS, F.col("status").alias("p_status"), F.col("confidence").alias("p_conf"))
    return fused(local.join(p, EVIDENCE_KEYS, "left"))


def fuse_proposals(local: DataFrame, proposed: DataFrame) -> DataFrame:
    """``fuse_evidence`` of proposals that weren't validated, where the local evidence is the rubric itself.

    The join that fuses is then the one that validates: both sides are shuffled once, in many parts (``together``). Where a
    criterion repeats, a proposal for it does too, as in ``validate_proposed_evidence``."""
    criteria = together(local.select(*EVIDENCE_KEYS, "k", "description", "max_marks", "notes", "status", "confidence"), *EVIDENCE_KEYS)
    criteria = criteria.withColumn("copies", F.count("*").over(Window.partitionBy(*EVIDENCE_KEYS)).cast("int"))
    p = together(cleaned_proposals(proposed).select(*EVIDENCE_KEYS, F.col("status").alias("p_status"), F.col("confidence").alias("p_conf")), *EVIDENCE_KEYS)
    rows = criteria.join(p, EVIDENCE_KEYS, "left")
    return fused(rows.select("*", F.explode(F.array_repeat(F.lit(True), F.when(F.col("p_status").isNull(), 1).otherwise(F.col("copies")))).alias("copy")))


def fused(rows: DataFrame) -> DataFrame:
    """Status, confidence and provenance of local evidence (status, confidence) beside a proposal's (p_status, p_conf; null: none)."""
    s, ps, c, pc = F.col("status"), F.col("p_status"), F.col("confidence"), F.col("p_conf")
    agree = s == ps
    solved = s.isin("uncertain", "missing", "partially_present") & ps.isin("present", "partially_present") & (pc >= 0.80)
    minor = ((s == "partially_present") & (ps == "present")) | ((s == "present") & (ps == "partially_present"))
    status = F.when(ps.isNull() | agree, s).when(solved, ps).when(ps == "contradicted", ps).when(minor, "partially_present").otherwise("uncertain")
    conf = F.when(ps.isNull(), c).when(agree, F.least(F.lit(0.98), F.greatest(c, pc) + F.lit(0.10).cast("decimal(4,2)"))).when(solved | (ps == "contradicted"), pc).when(minor, F.greatest(F.lit(0.55), F.least(c, pc) - F.lit(0.15).cast("decimal(4,2)"))).otherwise(F.least(F.lit(0.40), c, pc))
    source = F.when(ps.isNull(), "local").when(agree, "fused_agreement").when(solved, "fused_resolution").otherwise("conflict_flagged")
    return rows.select(*EVIDENCE_KEYS, "k", "description", "max_marks", "notes", status.alias("status"), conf.cast("decimal(4,2)").alias("confidence"), source.alias("provenance"))


def fallback_evidence(criteria: DataFrame, failed: Column, has_text: Column) -> DataFrame:
    """After a failed proposal, what is missing in a written answer is uncertain; the question must be reviewed."""
    return criteria.withColumn("status", F.when(failed & has_text & (F.col("status") == "missing"), "uncertain").otherwise(F.col("status"))).withColumn("evaluation_method", F.when(failed, "local_fallback").otherwise("local"))


def criterion_credit(status: Column, notes: Column, max_marks: Column) -> Column:
    core = F.lower(F.coalesce(notes, F.lit(""))).contains("core")
    share = F.when(status == "present", 1.0).when(status == "partially_present", 0.6).when((status == "contradicted") & core, 0.0).when(status.isin("contradicted", "uncertain"), 0.5).otherwise(0.0)
    return mround(max_marks * share.cast("decimal(3,2)"))


#: Lists of evidence, and the kinds (``evidence_kind``) in each.
EVIDENCE_CLASSES = {"correct_evidence": (1,), "missing_evidence": (2,), "incorrect_evidence": (3, 4), "partial_evidence": (5,), "uncertain_evidence": (6,)}


def evidence_kind(status: Column, notes: Column) -> Column:
    """1 present, 2 missing, 3 core and 4 minor contradiction, 5 partially present, 6 uncertain; 0 what else there is."""
    core = F.lower(F.coalesce(notes, F.lit(""))).contains("core")
    return F.when(status == "present", 1).when(status == "missing", 2).when((status == "contradicted") & core, 3).when(status == "contradicted", 4).when(status == "partially_present", 5).when(status == "uncertain", 6).when(status.isNotNull(), 0).cast("byte")


def score_questions(criteria: DataFrame) -> DataFrame:
    """Marks, confidence, review flag and the labelled evidence of each question: criteria are collected and sorted once, after they are shuffled."""
    kind = evidence_kind(F.col("status"), F.col("notes"))
    rows = together(criteria.select("assessment_id", "question_id", "k", "description", "max_marks", "confidence", kind.alias("kind"), criterion_credit(F.col("status"), F.col("notes"), F.col("max_marks")).alias("credit")), "assessment_id", "question_id")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    say = lambda before, after="": F.concat(F.lit(before), "description", F.lit(after))
    told = (F.when(is_(1), say("✓ ")).when(is_(2), say("✗ Missing: ")).when(is_(3), say("✗ Core contradiction: ")).when(is_(4), say("⚠ Minor misstatement: "))
            .when(is_(5), say("⚠ ", " (Partial coverage)")).when(is_(6), say("? Insufficient evidence: ")))
    sums = rows.withColumn("told", told).groupBy("assessment_id", "question_id").agg(
        F.sum("max_marks").alias("max"), F.sum("credit").alias("sum"), F.avg("confidence").alias("mean"), F.bool_or(is_(6)).alias("uncertain"), F.bool_or(is_(3, 4)).alias("contradicted"), F.bool_or(is_(3)).alias("core"),
        F.array_sort(F.collect_list(F.when(F.col("told").isNotNull(), F.struct("k", "told", "kind")))).alias("all"))
    of = lambda kinds: F.transform(F.filter("all", lambda c: c["kind"].isin(*kinds)), lambda c: c["told"])
    sums = sums.withColumns({name: of(kinds) for name, kinds in EVIDENCE_CLASSES.items()})
    cap = F.when(F.col("uncertain"), 0.52).when(F.col("contradicted"), 0.68).otherwise(1.0)
    conf = mround(F.least(F.col("mean").cast("double"), cap))
    marks = F.when(F.col("core"), 0).otherwise(F.greatest(F.lit(0), F.least("sum", "max"))).cast("decimal(10,2)")
    review = F.col("uncertain") | F.col("contradicted") | (conf < CONFIDENT)
    return sums.select("assessment_id", "question_id", F.col("max").cast("decimal(10,2)").alias("max_marks"), marks.alias("awarded_marks"), conf.alias("confidence"), review.alias("needs_review"), F.when(review, "review_required").otherwise("graded").alias("status"), "correct_evidence", "missing_evidence", "incorrect_evidence", "partial_evidence", "uncertain_evidence")


def build_rubric(specs: DataFrame) -> DataFrame:
    """Criteria of each question by its type; the last takes what rounding leaves. specs as question_specs gives them."""
    said = F.nullif(strip(F.coalesce("correct_answer", F.lit(""))), F.lit(""))
    pair = F.when(F.size("concepts") > 0, F.array_join(F.slice("concepts", 1, 2), ", ")).otherwise("target concept")
    one = lambda d: F.array(F.struct(d.alias("description"), F.lit(1.0).alias("share")))
    two = lambda a, x, b, y: F.array(F.struct(a.alias("description"), F.lit(x).alias("share")), F.struct(b.alias("description"), F.lit(y).alias("share")))
    keyed = lambda text, plain: F.when(said.isNotNull(), F.concat(F.lit(text + ": "), said)).otherwise(F.lit(plain) if isinstance(plain, str) else plain)
    points = F.coalesce(F.col("key_points"), F.array().cast("array<string>")) if "key_points" in specs.columns else F.array().cast("array<string>")
    even = lambda a: F.transform(a, lambda d: F.struct(d.alias("description"), (F.lit(1.0) / F.size(a)).alias("share")))
    addressed = F.transform(F.slice("concepts", 1, 4), lambda c: F.concat(F.lit("Addresses concept: "), c))
    generic = F.when(F.size(addressed) > 0, addressed).otherwise(F.array(F.lit("States core concept"), F.lit("Explains supporting mechanism")))
    t = F.col("expected_answer_type")
    choice = F.when(F.col("correct_option").isNotNull(), F.concat(F.lit("Selects correct option ("), "correct_option", F.lit("): "), F.coalesce(said, F.lit("")))).otherwise("Selects the correct option choice")
    plan = (F.when(t == "mcq", one(choice)).when(t == "one_word", one(keyed("Provides accurate factual name or value", "Provides accurate factual name or value")))
            .when(t == "definition", two(keyed("Defines the core concept", F.concat(F.lit("Defines the core concept of "), pair, F.lit(" correctly"))), 0.7, F.concat(F.lit("Uses technical terminology related to "), pair), 0.3))
            .when(F.col("has_math"), two(F.lit("Correct formula and step-by-step calculation method"), 0.6, keyed("Correct final numerical value and units", "Correct final numerical value and units"), 0.4))
            .when(F.col("has_diagram"), two(F.lit("Required diagram structure, components, and labels"), 0.5, F.lit("Accurate text explanation of the diagram"), 0.5))
            .when(F.size(points) >= 2, even(F.transform(points, lambda k: F.concat(F.lit("Addresses key point: "), k)))).otherwise(even(generic)))
    # outer: for a plain posexplode Spark filters by the plan's size first, which makes it twice
    rows = specs.select("assessment_id", "question_id", "resolved_marks", plan.alias("plan")).select("assessment_id", "question_id", "resolved_marks", F.size("plan").alias("n"), F.posexplode_outer("plan").alias("k", "c")).where("c is not null")
    part = mround(F.col("resolved_marks") * F.col("c.share"))
    w = Window.partitionBy("assessment_id", "question_id")
    rows = rows.withColumn("part", part).withColumn("sum", F.sum("part").over(w))
    marks = F.when(F.col("k") == F.col("n") - 1, F.col("part") + F.col("resolved_marks") - F.col("sum")).otherwise(F.col("part")).cast("decimal(10,2)")
    return rows.select("assessment_id", "question_id", F.concat(F.lit("c"), F.col("k") + 1).alias("criterion_id"), "k", F.col("c.description").alias("description"), marks.alias("max_marks"))


def grade_unanswered(questions: DataFrame) -> DataFrame:
    return questions.where("unanswered").select("assessment_id", "question_id", F.col("resolved_marks").alias("max_marks"), F.lit(0).cast("decimal(10,2)").alias("awarded_marks"), F.lit(0.95).cast("decimal(10,2)").alias("confidence"), F.lit(False).alias("needs_review"), F.lit("unanswered").alias("status"))


def feedback_text(scored: DataFrame) -> DataFrame:
    """The score line and the first two of each evidence class."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, 2), "; ")))
    head = F.concat(F.lit("Score: "), "awarded_marks", F.lit("/"), "max_marks", F.lit(" (Confidence: "), F.floor(F.col("confidence") * 100), F.lit("%)."))
    return scored.withColumn("feedback", F.concat_ws(" ", head, part("Key Strengths", "correct_evidence"), part("Notes", "incorrect_evidence"), part("Missing", "missing_evidence"), part("Uncertain", "uncertain_evidence")))


def token_accounting(graded: DataFrame) -> DataFrame:
    """Estimated use of an external evaluator by assessment. graded: assessment_id, method."""
    m = F.col("method")
    return graded.groupBy("assessment_id").agg(F.count_if(m != "local+llm").alias("local_evaluations"), F.count_if(m == "local+llm").alias("llm_evaluations"), F.count_if(m == "local").alias("llm_calls_avoided"), F.count_if(m == "local_fallback").alias("llm_failures"),
        F.sum(F.when(m == "local+llm", 450).otherwise(0)).alias("input_tokens"), F.sum(F.when(m == "local+llm", 150).otherwise(0)).alias("output_tokens"), F.sum(F.when(m == "local", 1200).otherwise(0)).alias("tokens_saved"))


def batches(questions: DataFrame, size: int = BATCH) -> DataFrame:
    """Fixed chunks of each assessment's unsolved questions, for an external solver."""
    w = Window.partitionBy("assessment_id").orderBy("order_index", "id")
    return unsolved(questions).select("assessment_id", "id", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("batch"))


def unsolved(questions: DataFrame, only_choice: bool = False) -> DataFrame:
    blank = lambda c: F.coalesce(strip(col(c)), F.lit("")) == ""
    if only_choice:
        return questions.where(blank("correct_option") & F.col("text").contains("(A)"))
    return questions.where(blank("correct_answer") & blank("correct_option"))
