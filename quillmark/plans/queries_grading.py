"""Queries of the grading path."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.steps import written
from quillmark.functions.text import words
from quillmark.operators import grading as G
from quillmark.operators import matching as MT
from quillmark.plans.entries import BODIES, joined, query
from quillmark.plans.fixtures import table as T

E = "criterion_evidence"
KEYS = ["assessment_id", "question_id"]
CREDIT = "round_even(cast(max_marks * (case when status = 'present' then 1.00 when status = 'partially_present' then 0.60 when status = 'contradicted' and contains(lower(notes), 'core') then 0.00 when status in ('contradicted', 'uncertain') then 0.50 else 0.00 end) as decimal(12,3)), 2)"
SCORED = f"""
  select assessment_id, question_id, mx as max_marks, case when core then 0 else greatest(0, least(s, mx)) end::decimal(10,2) as awarded_marks, round_even(cast(least(m::double, case when unc then 0.52 when contra then 0.68 else 1.0 end) as decimal(12,3)), 2)::decimal(10,2) as confidence, unc, contra, core, c1, m1, i1, p1, u1
  from (select assessment_id, question_id, sum(max_marks)::decimal(10,2) mx, sum({CREDIT}) s, avg(confidence) m, bool_or(status = 'uncertain') unc, bool_or(status = 'contradicted') contra, bool_or(status = 'contradicted' and contains(lower(notes), 'core')) core,
    coalesce(string_agg('✓ ' || description, ' | ' order by k) filter (status = 'present'), '') c1, coalesce(string_agg('✗ Missing: ' || description, ' | ' order by k) filter (status = 'missing'), '') m1,
    coalesce(string_agg(case when contains(lower(notes), 'core') then '✗ Core contradiction: ' else '⚠ Minor misstatement: ' end || description, ' | ' order by k) filter (status = 'contradicted'), '') i1,
    coalesce(string_agg('⚠ ' || description || ' (Partial coverage)', ' | ' order by k) filter (status = 'partially_present'), '') p1, coalesce(string_agg('? Insufficient evidence: ' || description, ' | ' order by k) filter (status = 'uncertain'), '') u1
  from criterion_evidence group by 1, 2)"""


@query("a1_score_question", f"select assessment_id, question_id, max_marks, awarded_marks, confidence, unc or contra or confidence < 0.85 as needs_review, case when unc or contra or confidence < 0.85 then 'review_required' else 'graded' end as status, c1 as correct_evidence, m1 as missing_evidence, i1 as incorrect_evidence, p1 as partial_evidence, u1 as uncertain_evidence from ({SCORED})")
def a1(s, d):
    return joined(G.score_questions(T(s, d, E)), "correct_evidence", "missing_evidence", "incorrect_evidence", "partial_evidence", "uncertain_evidence")


@query("p29_grading_feedback", f"""
  select assessment_id, question_id, concat_ws(' ', 'Score: ' || awarded_marks || '/' || max_marks || ' (Confidence: ' || floor(confidence * 100)::bigint || '%).', 'Key Strengths: ' || x(c1), 'Notes: ' || x(i1), 'Missing: ' || x(m1), 'Uncertain: ' || x(u1)) as feedback
  from ({SCORED})""".replace("x(c1)", "nullif(array_to_string(string_split(c1, ' | ')[:2], '; '), '')").replace("x(i1)", "nullif(array_to_string(string_split(i1, ' | ')[:2], '; '), '')").replace("x(m1)", "nullif(array_to_string(string_split(m1, ' | ')[:2], '; '), '')").replace("x(u1)", "nullif(array_to_string(string_split(u1, ' | ')[:2], '; '), '')"))  # fmt: skip
def p29(s, d):
    return G.feedback_text(G.score_questions(T(s, d, E))).select(*KEYS, "feedback")


VALID = """
  select assessment_id, question_id, criterion_id, case when lower(p.status) in ('present', 'partially_present', 'missing', 'contradicted', 'uncertain') then lower(p.status) else 'uncertain' end as status,
    greatest(0, least(1, p.confidence))::decimal(4,2) as confidence, evidence as evidence_text, e.description, e.max_marks from proposed_evidence p join criterion_evidence e using (assessment_id, question_id, criterion_id)"""


@query("f4_validate_proposed_evidence", f"select *, case when status <> 'contradicted' then 'LLM evidence interpretation (status=' || status || ')' when contains(lower(evidence_text), 'core') then 'Core contradiction identified by LLM evidence' else 'Minor contradiction identified by LLM evidence' end as notes from ({VALID})")
def f4(s, d):
    return G.validate_proposed_evidence(T(s, d, "proposed_evidence"), T(s, d, E))


FUSED = f"""
  select assessment_id, question_id, criterion_id, k, description, max_marks, notes, case when ps is null or s = ps then s when solved or ps = 'contradicted' then ps when minor then 'partially_present' else 'uncertain' end as status,
    (case when ps is null then c when s = ps then least(0.98, greatest(c, pc) + 0.10) when solved or ps = 'contradicted' then pc when minor then greatest(0.55, least(c, pc) - 0.15) else least(0.40, c, pc) end)::decimal(4,2) as confidence,
    case when ps is null then 'local' when s = ps then 'fused_agreement' when solved then 'fused_resolution' else 'conflict_flagged' end as provenance
  from (select e.assessment_id, e.question_id, e.criterion_id, e.k, e.description, e.max_marks, e.notes, e.status s, e.confidence c, v.status ps, v.confidence pc, e.status in ('uncertain', 'missing', 'partially_present') and v.status in ('present', 'partially_present') and v.confidence >= 0.80 as solved,
      (e.status = 'partially_present' and v.status = 'present') or (e.status = 'present' and v.status = 'partially_present') as minor
    from criterion_evidence e left join ({VALID}) v using (assessment_id, question_id, criterion_id))"""


@query("j11_fuse_evidence", FUSED)
def j11(s, d):
    return G.fuse_proposals(T(s, d, E), T(s, d, "proposed_evidence"))


@query("j12_fallback_evidence", "select assessment_id, question_id, criterion_id, case when ord % 4 = 0 and ord % 8 <> 0 and status = 'missing' then 'uncertain' else status end as status, case when ord % 4 = 0 then 'local_fallback' else 'local' end as evaluation_method from criterion_evidence")
def j12(s, d):
    return G.fallback_evidence(T(s, d, E), F.col("ord") % 4 == 0, F.col("ord") % 8 != 0).select(*KEYS, "criterion_id", "status", "evaluation_method")


@query("a22_token_accounting", "select assessment_id, count(*) filter (m <> 'local+llm') as local_evaluations, count(*) filter (m = 'local+llm') as llm_evaluations, count(*) filter (m = 'local') as llm_calls_avoided, count(*) filter (m = 'local_fallback') as llm_failures, sum(case when m = 'local+llm' then 450 else 0 end)::bigint as input_tokens, sum(case when m = 'local+llm' then 150 else 0 end)::bigint as output_tokens, sum(case when m = 'local' then 1200 else 0 end)::bigint as tokens_saved from (select assessment_id, grading_provenance m from question_results) group by 1")
def a22(s, d):
    return G.token_accounting(T(s, d, "question_results").select("assessment_id", F.col("grading_provenance").alias("method")))


@query("w8_call_budget", "select assessment_id, question_id, case when asks and n > 3 then 'REVIEW_REQUIRED' else decision end as decision from (select *, decision <> 'LOCAL' as asks, count(*) filter (decision <> 'LOCAL') over (partition by assessment_id order by ord, question_id rows unbounded preceding) n from (select assessment_id, question_id, ord, case when supp % 3 = 0 then 'LOCAL' when supp % 3 = 1 then 'LLM_REQUIRED' else 'LLM_RECOMMENDED' end decision from question_results))")
def w8(s, d):
    q = T(s, d, "question_results").selectExpr("assessment_id", "question_id", "ord", "case when supp % 3 = 0 then 'LOCAL' when supp % 3 = 1 then 'LLM_REQUIRED' else 'LLM_RECOMMENDED' end as decision", "'' as reason")
    return G.call_budget(q, 3).select(*KEYS, "decision")


@query("f6_unsolved_questions", "select assessment_id, id from questions where coalesce(trim(correct_answer), '') = '' and coalesce(trim(correct_option), '') = ''")
def f6(s, d):
    return G.unsolved(T(s, d, "questions")).select("assessment_id", "id")


@query("w7_batches", "select assessment_id, id, ((row_number() over (partition by assessment_id order by order_index, id) - 1) // 2)::integer as batch from questions where coalesce(trim(correct_answer), '') = '' and coalesce(trim(correct_option), '') = ''")
def w7(s, d):
    return G.batches(T(s, d, "questions"), 2)


def specs(s, d):
    return G.question_specs(T(s, d, "questions").withColumnRenamed("id", "question_id"))


RESOLVED = """
  case when max_marks > 0 then max_marks when regexp_matches(text, '\\[?\\b\\d{1,2}(\\.\\d)?\\s*(marks?|m|pts?|points?)\\b', 'i') then regexp_extract(text, '\\[?\\b(\\d{1,2}(?:\\.\\d)?)\\s*(?:marks?|m|pts?|points?)\\b', 1, 'i')::decimal(10,2)
      when section = 'SECTION-A' then 2 when section = 'Part B' then 5 else 2 end::decimal(10,2) as resolved_marks"""


@query("p8_resolve_max_marks", f"""
  select assessment_id, id as question_id, {RESOLVED},
    case when max_marks > 0 then 'vlm_direct' when regexp_matches(text, '\\[?\\b\\d{{1,2}}(\\.\\d)?\\s*(marks?|m|pts?|points?)\\b', 'i') then 'high' else 'medium' end as marks_confidence from questions""")  # fmt: skip
def p8(s, d):
    return specs(s, d).select(*KEYS, "resolved_marks", "marks_confidence")


#: Questions with what the patterns look at: s (stripped), low (lower case), n (words) and the flags.
FLAGGED = rf"""
  (select assessment_id, question_id, resolved_marks, s, low, case when s = '' then 0 else len(regexp_split_to_array(s, '\s+')) end as n, regexp_matches(low, '{G.DIAGRAM}') as has_diagram,
      regexp_matches(low, '{G.MATH_WORDS}') or regexp_matches(s, '{G.MATH_SIGNS}') as has_math, regexp_matches(low, '{G.CODE}') as has_code
    from (select *, lower(s) as low from (select assessment_id, id as question_id, {RESOLVED}, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from questions)))"""


ANSWER_TYPES = rf"""
  select assessment_id, question_id, has_diagram, has_math, has_code,
    case when regexp_matches(s, '\([A-D]\)') or regexp_matches(s, '^\s*\(?[A-D]\)?\s*[.\-]') then 'mcq' when regexp_matches(low, '{G.FACT}') and n <= 15 then 'one_word'
      when regexp_matches(low, '\b(define|meaning of|what do you understand by)\b') or (regexp_matches(low, '\bwhat is\b') and n <= 15 and not regexp_matches(low, '\b(unit|formula|symbol|name|value)\b')) then 'definition'
      when has_code then 'code' when contains(low, 'algorithm') then 'algorithm' when has_math and regexp_matches(low, 'derive|proof') then 'mathematical_derivation' when has_math then 'numerical'
      when has_diagram and regexp_matches(low, 'explain|describe') then 'diagram_explanation' when has_diagram then 'diagram' when regexp_matches(low, '\b(differentiate|compare|difference between|vs|versus)\b') then 'comparison'
      when regexp_matches(low, '\b(steps|process|procedure|working of|how does)\b') then 'process' when resolved_marks >= 7 or n > 25 or regexp_matches(low, 'with example|in detail') then 'long_conceptual'
      when resolved_marks <= 2 or n <= 15 then 'short_conceptual' else 'explanation' end as expected_answer_type
  from {FLAGGED}"""


@query("p9_expected_answer_type", ANSWER_TYPES)
def p9(s, d):
    return specs(s, d).select(*KEYS, "expected_answer_type", "has_diagram", "has_math", "has_code")


STOP = ", ".join(f"'{w}'" for w in G.STOP_WORDS)


CONCEPTS = f"(select assessment_id, id, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select assessment_id, id, list_filter(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{3,}}')), lambda x: lower(x)), lambda x: x not in ({STOP})) l from questions))"


@query("p10_required_concepts", f"select assessment_id, id as question_id, array_to_string(list_distinct_ordered, ' | ') as concepts from {CONCEPTS}")
def p10(s, d):
    return joined(specs(s, d).select(*KEYS, "concepts"), "concepts")


def answered(s, d):
    """Questions with the turn after them as the answer; every ninth is unanswered."""
    q, a = specs(s, d), T(s, d, "answers").select("assessment_id", (F.col("order_index") - 1).alias("order_index"), F.col("text").alias("answer_text"))
    rows = q.join(a, ["assessment_id", "order_index"], "left")
    text = F.when(F.col("assessment_id") % 9 == 0, None).otherwise(F.col("answer_text"))
    rows = rows.withColumn("answer_text", text).withColumn("has_regions", F.col("answer_text").isNotNull())
    return rows.withColumns({"unanswered": F.coalesce(F.trim("answer_text"), F.lit("")) == "", "content_type": G.answer_content_type(F.col("answer_text"), F.col("has_regions")), "n_words": words(F.coalesce("answer_text", F.lit("")))})


#: Questions with their answers in SQL; s is the answer, stripped.
ANSWERED = r"""
  (select *, regexp_replace(coalesce(answer_text, ''), '^\s+|\s+$', '', 'g') as s from (select q.assessment_id, q.id as question_id, q.text, q.correct_answer, q.correct_option, case when q.assessment_id % 9 <> 0 then a.t end as answer_text
    from questions q left join (select assessment_id, order_index - 1 as order_index, text as t from answers) a on a.assessment_id = q.assessment_id and a.order_index = q.order_index))"""


@query("p7_answer_content_type", rf"""
  select assessment_id, question_id, case when s = '' then case when answer_text is null then 'unknown' else 'visual_only' end
      when regexp_matches(s, '^\(?[A-Da-d]\)?$') or regexp_matches(s, '^(option|ans(wer)?)\s*[:.\-]?\s*\(?[A-Da-d]\)?$', 'i') or regexp_matches(s, '^([Qq]?\d+[.)\-]?\s*)?\(?[A-Da-d]\)([.:\-)]|\s+)') or regexp_matches(s, '^[Qq]?\d+[.)\-]?\s*[A-Da-d][.:\-)]\s+') then 'mcq_selection'
      when regexp_matches(s, '^[+\-]?\d+(\.\d+)?$') then 'number' when regexp_matches(s, '\b(def |class |import |for |while |return |public static|if __name__|std::)\b') or regexp_matches(s, '(?m)[{{}};]\s*$') then 'code'
      when math and n <= 5 then 'formula' when math then 'mathematical_work' when n <= 4 then 'short_text' when n >= 40 then 'long_text' else 'text' end as content_type
  from (select *, case when s = '' then 0 else len(regexp_split_to_array(s, '\s+')) end as n, regexp_matches(s, '[=+\-*/^√∫Σλπθ∂]|\\frac|\\sqrt') as math from {ANSWERED})""")  # fmt: skip
def p7(s, d):
    return answered(s, d).select(*KEYS, "content_type")


@query("a3_grade_unanswered", "select q.assessment_id, q.id as question_id, 0.00::decimal(10,2) as awarded_marks, 0.95::decimal(10,2) as confidence, false as needs_review, 'unanswered' as status from questions q left join (select assessment_id, order_index - 1 as order_index, text as t from answers) a using (assessment_id, order_index) where q.assessment_id % 9 = 0 or coalesce(trim(t), '') = ''")
def a3(s, d):
    return G.grade_unanswered(answered(s, d)).drop("max_marks")


KEYED = "case when said is null then '{0}' else '{0}: ' || said end"
RUBRIC = f"""
  (select assessment_id, question_id, resolved_marks, case when expected_answer_type = 'mcq' then [{{d: case when correct_option is null then 'Selects the correct option choice' else 'Selects correct option (' || correct_option || '): ' || coalesce(said, '') end, share: 1.0::double}}]
      when expected_answer_type = 'one_word' then [{{d: {KEYED.format("Provides accurate factual name or value")}, share: 1.0::double}}]
      when expected_answer_type = 'definition' then [{{d: case when said is null then 'Defines the core concept of ' || pair || ' correctly' else 'Defines the core concept: ' || said end, share: 0.7::double}}, {{d: 'Uses technical terminology related to ' || pair, share: 0.3::double}}]
      when has_math then [{{d: 'Correct formula and step-by-step calculation method', share: 0.6::double}}, {{d: {KEYED.format("Correct final numerical value and units")}, share: 0.4::double}}]
      when has_diagram then [{{d: 'Required diagram structure, components, and labels', share: 0.5::double}}, {{d: 'Accurate text explanation of the diagram', share: 0.5::double}}]
      when len(c) > 0 then list_transform(c[:4], lambda x: {{d: 'Addresses concept: ' || x, share: 1::double / len(c[:4])}}) else [{{d: 'States core concept', share: 0.5::double}}, {{d: 'Explains supporting mechanism', share: 0.5::double}}] end as plan
    from (select assessment_id, id as question_id, resolved_marks, correct_option, nullif(trim(correct_answer), '') as said, list_distinct_ordered as c, case when len(list_distinct_ordered) > 0 then array_to_string(list_distinct_ordered[:2], ', ') else 'target concept' end as pair, expected_answer_type, has_math, has_diagram
      from questions join {CONCEPTS} using (assessment_id, id) join (select assessment_id as assessment_id, question_id as id, resolved_marks from {FLAGGED}) using (assessment_id, id) join (select assessment_id, question_id as id, expected_answer_type, has_math, has_diagram from ({ANSWER_TYPES})) using (assessment_id, id)))"""


@query("a2_build_rubric", f"""
  select assessment_id, question_id, 'c' || (k + 1) as criterion_id, k, description, case when k = n - 1 then part + resolved_marks - sum(part) over (partition by assessment_id, question_id) else part end::decimal(10,2) as max_marks
  from (select assessment_id, question_id, resolved_marks, k, len(plan) as n, plan[k + 1].d as description, round_even(cast(resolved_marks * plan[k + 1].share as decimal(12,3)), 2)::decimal(10,2) as part
    from (select *, unnest(range(0, len(plan)))::integer as k from {RUBRIC}))""")  # fmt: skip
def a2(s, d):
    return G.build_rubric(specs(s, d))


@query("p20_numeric_answer_score", rf"""
  select assessment_id, question_id, c[1]::double as score, c[2] = 1 as valid, c[3]::double as confidence
  from (select assessment_id, question_id, case when a = '' then [0, 0, 0.9] when len(list_filter(ks, lambda t: len(list_filter(xs, lambda x: abs(x - t) <= greatest(0.01, abs(t) * 0.02))) > 0)) > 0 then [1, 1, 0.98]
      when square and contains(a, '2') and contains(a, '3') then [1, 1, 0.95] when square and (contains(a, '2') or contains(a, '3')) then [0.5, 1, 0.85]
      when equations >= 2 and len(xs) > 0 then [0.85, 1, 0.8] when equations >= 2 then [0.7, 1, 0.8] when len(xs) > 0 then [0.9, 1, 0.85] else [0.5, 1, 0.6] end as c
    from (select *, coalesce(answer_text, '') as a, list_transform(regexp_extract_all(coalesce(answer_text, ''), '{G.NUMBER}'), lambda x: x::double) as xs, list_transform(regexp_extract_all(coalesce(correct_answer, ''), '{G.NUMBER}'), lambda x: x::double) as ks,
        contains(text, 'x^2 - 5x + 6') or contains(text, 'x^2-5x+6') as square, len(list_filter(regexp_split_to_array(coalesce(answer_text, ''), '\r?\n'), lambda x: contains(x, '='))) as equations from {ANSWERED}))""")  # fmt: skip
def p20(s, d):
    m = G.numeric_answer_score(F.col("text"), F.col("answer_text"), F.col("correct_answer"))
    return answered(s, d).withColumn("m", m).select(*KEYS, "m.score", "m.valid", "m.confidence")


@query("p21_code_answer_score", "select assessment_id, answer_id, case when trim(text) = '' then 0.0 when a and b then 0.95 when a or b then 0.7 else 0.5 end::double as score, case when trim(text) = '' then 0.9 when a then 0.85 else 0.65 end::double as confidence from (select *, regexp_matches(text, '\\b(def|class|for|while|if|return|public|void)\\b') a, regexp_matches(text, '\\b(return|print|output|yield|def|class)\\b') b from answers)")
def p21(s, d):
    return T(s, d, "answers").withColumn("c", G.code_answer_score(F.col("text"))).select("assessment_id", "answer_id", "c.score", "c.confidence")


@query("p22_visual_answer_flag", "select l_orderkey as assessment_id, l_linenumber as n, l_partkey as part, case when l_linenumber = 1 then 'missing' else 'uncertain' end as status, case when l_linenumber = 1 then 0.9 when l_quantity * l_quantity > 500 then 0.5 else 0.4 end::double as confidence from lineitem")
def p22(s, d):
    box = "named_struct('page', 1, 'bbox', named_struct('x', 0D, 'y', 0D, 'width', l_quantity, 'height', l_quantity))"
    rows = T(s, d, "lineitem").selectExpr("l_orderkey as assessment_id", "l_linenumber as n", "l_partkey as part", f"if(l_linenumber = 1, slice(array({box}), 1, 0), array({box})) as regions")
    return rows.withColumn("v", G.visual_answer_flag(F.col("regions"))).select("assessment_id", "n", "part", "v.status", "v.confidence")


@query("p19_contradiction_severity", "select assessment_id, answer_id, case when contains(t, 'dropout') and contains(t, 'increase') and (contains(t, 'neuron') or contains(t, 'capacity')) then 'core' when contains(t, 'never') or contains(t, 'opposite') or contains(t, 'incorrectly') then 'minor' else 'none' end as severity from (select *, lower(case order_index % 4 when 1 then 'Dropout will increase capacity. ' when 3 then 'It is never so. ' else '' end || text) t from answers)")
def p19(s, d):
    a = T(s, d, "answers").withColumn("t", F.concat(F.when(F.col("order_index") % 4 == 1, "Dropout will increase capacity. ").when(F.col("order_index") % 4 == 3, "It is never so. ").otherwise(""), "text"))
    return a.select("assessment_id", "answer_id", G.contradiction_severity(F.lit("topic"), F.col("t")).alias("severity"))


LETTERS = ("A", "B", "C", "D")


def options(s, d):
    """Four options of each question, the third holding what an answer without a letter may say."""
    o = F.posexplode(F.array(*(F.concat(F.lit(f"({x}) "), F.lit(b)) for x, b in zip(LETTERS, ("the first choice", "than in", "a value of seven", "none of these"), strict=True))))
    return T(s, d, "questions").select("assessment_id", F.col("id").alias("question_id"), o.alias("ord", "text"))


TOKENS = "list_distinct(regexp_extract_all({}, '[a-z0-9]+'))"
CHOSEN = rf"""
  (select r.assessment_id, r.question_id, s, answer_text, correct_option, coalesce(named, case when answer_text is not null then body end, early) as letter, regexp_matches(s, '^[Aa] ') as weak_letter
    from (select *, coalesce(nullif(upper(regexp_extract(s, '^(?:[Qq]?\d+[.)\-]?\s*)?\(?([A-Da-d])\)?(?:[.:\-)]|\s+|$)', 1)), ''), nullif(upper(regexp_extract(s, '\b(?:option|ans(?:wer)?|choice)\s*[:.\-]?\s*\(?([A-Da-d])\)?\b', 1, 'i')), '')) as named,
        nullif(upper(regexp_extract(s[:25], '[A-Da-d]')), '') as early from {ANSWERED}) r
    left join (select assessment_id, question_id, arg_max(x, {{score: score, i: -i}}) as body
      from (select assessment_id, question_id, i, x, case when contains(lower(s), b) or contains(b, lower(s)) then 2.0::double else len(list_intersect({TOKENS.format("lower(s)")}, {TOKENS.format("b")})) / greatest(1, len(list_distinct(list_concat({TOKENS.format("lower(s)")}, {TOKENS.format("b")})))) end as score
        from {ANSWERED}, (values (0, 'A', 'the first choice'), (1, 'B', 'than in'), (2, 'C', 'a value of seven'), (3, 'D', 'none of these')) o(i, x, b)) where score >= 0.4 group by 1, 2) using (assessment_id, question_id))"""


@query("p6_student_option_choice", f"select assessment_id, question_id, letter, weak_letter from {CHOSEN}")
def p6(s, d):
    return G.student_option_choice(answered(s, d).select(*KEYS, F.col("answer_text").alias("text")), options(s, d)).select(*KEYS, "letter", "weak_letter")


@query("p5_option_label", "select assessment_id, id || '-' || i as option, x as label, b as body from (select assessment_id, id, unnest([0, 1, 2, 3]) i, unnest(['A', 'B', 'C', 'D']) x, unnest(['the first choice', 'than in', 'a value of seven', 'none of these']) b from questions)")
def p5(s, d):
    o = options(s, d)
    return o.select("assessment_id", F.concat("question_id", F.lit("-"), "ord").alias("option"), G.option_label(F.col("text")).alias("label"), G.strip_option_prefix(F.col("text")).alias("body"))


def parts(s, d):
    """(answered, rubric), written: what follows reads both several times, and would match all patterns again for each."""
    return written(answered(s, d), "answered"), written(a2(s, d), "rubric")


def evidence(s, d, a, rubric):
    """Local evidence of every criterion: choices, numbers, regions, keys and lexical similarity. a, rubric: of ``parts``."""
    choice = G.student_option_choice(a.select(*KEYS, F.col("answer_text").alias("text")), options(s, d)).select(*KEYS, "letter")
    a = a.join(choice, KEYS, "left").withColumn("is_mcq", F.col("expected_answer_type") == "mcq")
    a = a.withColumns({"mcq": G.mcq_evidence(F.col("is_mcq"), F.col("unanswered"), F.col("correct_option"), F.col("letter")), "math": F.when(F.col("has_math"), G.numeric_answer_score(F.col("text"), F.col("answer_text"), F.col("correct_answer"))), "visual": F.when(F.col("has_diagram"), F.struct(F.lit("uncertain").alias("status"), F.lit(0.5).alias("confidence"))), "key_points": F.array().cast("array<string>")})
    texts = rubric.join(a.select(*KEYS, "text"), KEYS).select(F.concat_ws("/", *KEYS).alias("corpus_id"), F.col("criterion_id").alias("id"), F.concat_ws(" ", "description", "text").alias("text"))
    said = a.select(F.concat_ws("/", *KEYS).alias("corpus_id"), F.lit("answer").alias("id"), F.coalesce("answer_text", F.lit("")).alias("text"))
    sim = MT.lexical_similarity(texts, said).select("corpus_id", F.col("left_id").alias("criterion_id"), "similarity")
    rows = rubric.withColumn("corpus_id", F.concat_ws("/", *KEYS)).join(sim, ["corpus_id", "criterion_id"], "left").join(a.select(*KEYS, "answer_text", "unanswered", "mcq", "math", "visual", "correct_answer", "key_points", F.col("expected_answer_type").alias("answer_type")), KEYS)
    return G.criterion_status(rows)


@query("p23_mcq_evidence", f"""
  select assessment_id, question_id, case when gone then 'missing' when known is null then null when letter is null then 'uncertain' when letter = known then 'present' else 'missing' end as status,
    case when gone then 0.98 when known is null then null when letter is null then 0.5 else 0.98 end::double as confidence
  from (select *, coalesce(trim(answer_text), '') = '' as gone, nullif(upper(trim(correct_option)), '') as known from {CHOSEN})""")  # fmt: skip
def p23(s, d):
    a = answered(s, d).join(p6(s, d).select(*KEYS, "letter"), KEYS, "left")
    return a.withColumn("m", G.mcq_evidence(F.lit(True), F.col("unanswered"), F.col("correct_option"), F.col("letter"))).select(*KEYS, "m.status", "m.confidence")


DESCRIPTION_STOP = ", ".join(f"'{w}'" for w in G.DESCRIPTION_STOP_WORDS)
#: Similarity of each criterion (with its question) to the answer, fitted on the criteria and the answer of one question.
CRITERION_SIMILARITY = rf"""
  (with r as ({BODIES["a2_build_rubric"]}), x as (select r.assessment_id, r.question_id, criterion_id as id, 'l' as side, concat_ws(' ', description, a.text) as body from r join {ANSWERED} a using (assessment_id, question_id)
      union all select assessment_id, question_id, 'answer', 'r', coalesce(answer_text, '') from {ANSWERED}),
    t as (select assessment_id, question_id, id, side, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')) as term from x), tf as (select *, count(*) as tf from t group by all), df as (select assessment_id, question_id, term, count(*) as df from tf group by all),
    n as (select assessment_id, question_id, count(*) as n from x group by all), w as (select tf.*, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (assessment_id, question_id, term) join n using (assessment_id, question_id)),
    u as (select *, w / sqrt(sum(w * w) over (partition by assessment_id, question_id, side, id)) as u from w)
  select a.assessment_id, a.question_id, a.id as criterion_id, least(1.0, sum(a.u * b.u)) as similarity from u a join u b on a.assessment_id = b.assessment_id and a.question_id = b.question_id and a.term = b.term and a.side = 'l' and b.side = 'r' group by all)"""
#: Criteria with everything the rules look at, then the first rule that decides.
EVIDENCE = rf"""
  (select *, case when by_choice then mcq_status when gone then 'missing' when math_on then case when math_score >= 0.85 then 'present' when math_score >= 0.4 then 'partially_present' else 'missing' end when visual_on then 'uncertain'
      when keyed and direct then 'present' when keyed and short_key and not word_match then 'missing' when s <> '' and severity <> 'none' then 'contradicted' when full_match then 'present' when sim >= 0.20 or word_match then 'partially_present' else 'missing' end as evidence_status,
    case when by_choice then mcq_confidence when gone then 0.95 when math_on then math_confidence when visual_on then 0.5 when keyed and direct then 0.96 when keyed and short_key and not word_match then 0.95 when s <> '' and severity <> 'none' then 0.85
      when full_match then least(0.95, greatest(0.75, case when n_words <= 4 then 0.90 else sim + 0.35 end)) when sim >= 0.20 or word_match then 0.7 when length(s) < 5 then 0.9 else 0.85 end::double as evidence_confidence
  from (select *, word_match and n_words <= 4 or sim >= 0.30 or word_match and n_words >= 8 as full_match, length(wanted) >= 2 as keyed, contains(low, wanted) or (contains(wanted, low) and length(low) >= 3) as direct,
      answer_type in ('one_word', 'mcq') or (case when wanted = '' then 0 else len(regexp_split_to_array(wanted, '\s+')) end) <= 2 as short_key, answer_type = 'mcq' and mcq_status is not null as by_choice
    from (select r.*, a.s, lower(a.s) as low, a.answer_text, coalesce(trim(a.answer_text), '') = '' as gone, case when a.s = '' then 0 else len(regexp_split_to_array(a.s, '\s+')) end as n_words, lower(regexp_replace(coalesce(a.correct_answer, ''), '^\s+|\s+$', '', 'g')) as wanted, coalesce(similarity, 0) as sim, t.expected_answer_type as answer_type, t.has_diagram,
        c.status as mcq_status, c.confidence as mcq_confidence, m.score as math_score, m.confidence as math_confidence,
        regexp_matches(lower(description), 'calculation|formula|numeric') and t.has_math and coalesce(m.valid, false) as math_on, regexp_matches(lower(description), 'diagram|sketch|visual') and t.has_diagram as visual_on,
        len(list_filter(regexp_extract_all(description, '\b([a-zA-Z]{{3,}})\b', 1), lambda w: lower(w) not in ({DESCRIPTION_STOP}) and contains(lower(a.s), lower(w)))) > 0 as word_match,
        case when ((contains(lower(description), 'dropout') or contains(lower(a.s), 'dropout')) and contains(lower(a.s), 'increase') and regexp_matches(lower(a.s), 'neuron|capacity')) or (regexp_matches(lower(description), 'vanishing gradient|relu') and contains(lower(a.s), 'relu causes vanishing gradient')) then 'core' when regexp_matches(lower(a.s), 'never|opposite|incorrectly') then 'minor' else 'none' end as severity
      from ({BODIES["a2_build_rubric"]}) r join {ANSWERED} a using (assessment_id, question_id) join ({BODIES["p9_expected_answer_type"]}) t using (assessment_id, question_id) join ({BODIES["p20_numeric_answer_score"]}) m using (assessment_id, question_id)
        join ({BODIES["p23_mcq_evidence"]}) c using (assessment_id, question_id) left join {CRITERION_SIMILARITY} l using (assessment_id, question_id, criterion_id))))"""


@query("p24_criterion_status", f"select assessment_id, question_id, criterion_id, description, max_marks, evidence_status, round_even(evidence_confidence, 6) as evidence_confidence from {EVIDENCE}")
def p24(s, d):
    return evidence(s, d, *parts(s, d)).select(*KEYS, "criterion_id", "description", "max_marks", "evidence_status", F.bround("evidence_confidence", 6).alias("evidence_confidence"))


def local_criteria(s, d, a, rubric):
    return evidence(s, d, a, rubric).select(*KEYS, "criterion_id", "k", "description", "max_marks", F.col("evidence_status").alias("status"), F.col("evidence_confidence").cast("decimal(4,2)").alias("confidence"), F.col("evidence_notes").alias("notes"))


def routed(a, criteria):
    q = a.withColumnRenamed("expected_answer_type", "answer_type").select(*KEYS, "order_index", "unanswered", "content_type", "answer_type", "has_diagram", "n_words", "has_regions")
    return G.grading_route(q, criteria).select(*KEYS, "decision", "reason")


#: Local evidence as it is scored, the route of each question, and what of it stands where a proposal has failed.
LOCAL = f"(select assessment_id, question_id, criterion_id, k, description, max_marks, evidence_status as status, round(evidence_confidence, 2)::decimal(4,2) as confidence, case when evidence_status = 'contradicted' then 'Contradiction detected (' || severity || ' severity)' end as notes from {EVIDENCE})"
ROUTES = f"""
  (select assessment_id, question_id, q.text, q.answer_text, gone, route[1] as decision, route[2] as reason
  from (select *, case when gone then ['LOCAL_CLEAR_WITH_HIGH_CONFIDENCE', 'unanswered'] when fact and unsure then ['LLM_RECOMMENDED', 'mcq_option_uncertain'] when fact then ['LOCAL_CLEAR_WITH_HIGH_CONFIDENCE', 'clear_short_factual_or_mcq']
        when (has_diagram or content_type in ('diagram', 'visual_only')) and has_regions then ['LLM_REQUIRED', 'diagram_visual_understanding'] when contra then ['LLM_REQUIRED', 'contradiction_severity_uncertain'] when part or unsure then ['LLM_RECOMMENDED', 'semantic_ambiguity']
        when deep then ['LLM_RECOMMENDED', 'complex_conceptual_paraphrasing'] when mean < 0.75 then ['LLM_REQUIRED', 'local_confidence_low'] else ['LOCAL_CLEAR_WITH_HIGH_CONFIDENCE', 'local_evidence_high_confidence'] end as route
    from (select a.*, coalesce(trim(a.answer_text), '') = '' as gone, a.answer_text is not null as has_regions, c.content_type, t.has_diagram, c.content_type in ('mcq_selection', 'number') or expected_answer_type in ('mcq', 'one_word') as fact,
        expected_answer_type in ('explanation', 'long_conceptual', 'short_conceptual', 'process', 'comparison', 'definition') and (case when a.s = '' then 0 else len(regexp_split_to_array(a.s, '\\s+')) end) > 4 as deep,
        bool_or(l.status = 'uncertain') as unsure, bool_or(l.status = 'contradicted') as contra, bool_or(l.status = 'partially_present') as part, avg(l.confidence) as mean
      from {ANSWERED} a join ({BODIES["p7_answer_content_type"]}) c using (assessment_id, question_id) join ({BODIES["p9_expected_answer_type"]}) t using (assessment_id, question_id) left join {LOCAL} l using (assessment_id, question_id)
      group by all)) q)"""


@query("p25_grading_route", f"select assessment_id, question_id, decision, reason from {ROUTES}")
def p25(s, d):
    a, rubric = parts(s, d)
    return routed(a, local_criteria(s, d, a, rubric))


GRADED = f"""
  (select l.* exclude (status), decision, failed, case when failed and status = 'missing' then 'uncertain' else status end as status from (select l.*, decision, decision in ('LLM_REQUIRED', 'LLM_RECOMMENDED') and assessment_id % 4 = 0 as failed from {LOCAL} l join {ROUTES} r using (assessment_id, question_id) where not gone) l)"""
FIRST_TWO = "array_to_string(list(case when {0} then {1} || description end order by k) filter ({0})[:2], '; ')"


@query("a25_grade_answers", f"""
  with g as {GRADED},
  s as (select assessment_id, question_id, any_value(decision) as decision, bool_or(failed) as failed, sum(max_marks)::decimal(10,2) as mx, sum({CREDIT}) as total, avg(confidence) as mean, bool_or(status = 'uncertain') as unc, bool_or(status = 'contradicted') as contra, bool_or(status = 'contradicted' and contains(lower(coalesce(notes, '')), 'core')) as core,
      'Key Strengths: ' || nullif({FIRST_TWO.format("status = 'present'", "'✓ '")}, '') as f1, 'Notes: ' || nullif({FIRST_TWO.format("status = 'contradicted'", "case when contains(lower(coalesce(notes, '')), 'core') then '✗ Core contradiction: ' else '⚠ Minor misstatement: ' end")}, '') as f2,
      'Missing: ' || nullif({FIRST_TWO.format("status = 'missing'", "'✗ Missing: '")}, '') as f3, 'Uncertain: ' || nullif({FIRST_TWO.format("status = 'uncertain'", "'? Insufficient evidence: '")}, '') as f4
    from g group by 1, 2),
  m as (select *, case when core then 0 else greatest(0, least(total, mx)) end::decimal(10,2) as marks, round_even(cast(least(mean::double, case when unc then 0.52 when contra then 0.68 else 1.0 end) as decimal(12,3)), 2)::decimal(10,2) as conf from s)
  select assessment_id, question_id, mx as max_marks, marks as awarded_marks, case when failed then least(conf, 0.52) else conf end::decimal(10,2) as confidence, failed or unc or contra or conf < 0.85 as needs_review, case when failed or unc or contra or conf < 0.85 then 'review_required' else 'graded' end as status, decision,
    concat_ws(' ', 'Score: ' || marks || '/' || mx || ' (Confidence: ' || floor(conf * 100)::bigint || '%).', f1, f2, f3, f4) as feedback from m
  union all select assessment_id, id, resolved_marks, 0.00::decimal(10,2), 0.95::decimal(10,2), false, 'unanswered', 'LOCAL_CLEAR_WITH_HIGH_CONFIDENCE', 'No student answer submitted.'
  from (select assessment_id, id, {RESOLVED} from questions) join (select assessment_id, question_id as id from {ROUTES} where gone) using (assessment_id, id)""")
def a25(s, d):
    """Specification, rubric, local evidence, route, marks; unanswered questions beside. Escalated questions whose number is divisible by 4 stand for failed proposals."""
    a, rubric = parts(s, d)
    local = written(local_criteria(s, d, a, rubric), "evidence")
    asked = F.col("decision").isin("LLM_REQUIRED", "LLM_RECOMMENDED")
    failed = asked & (F.col("assessment_id") % 4 == 0)
    kept = G.fallback_evidence(local.join(routed(a, local), KEYS), failed, F.lit(True))
    open_ = G.grade_unanswered(a)
    how = kept.groupBy(*KEYS).agg(F.first("evaluation_method").alias("method"), F.first("decision").alias("decision"))
    scored = G.feedback_text(G.score_questions(kept)).join(how, KEYS).join(open_.select(*KEYS), KEYS, "left_anti")
    back = F.col("method") == "local_fallback"
    scored = scored.select(*KEYS, "max_marks", "awarded_marks", F.when(back, F.least("confidence", F.lit(0.52))).otherwise(F.col("confidence")).cast("decimal(10,2)").alias("confidence"), (F.col("needs_review") | back).alias("needs_review"), F.when(back, "review_required").otherwise(F.col("status")).alias("status"), "decision", "feedback")
    return scored.unionByName(open_.withColumns({"decision": F.lit("LOCAL_CLEAR_WITH_HIGH_CONFIDENCE"), "feedback": F.lit("No student answer submitted.")}))


@query("s8_build_requests", f"""
  with c as (select assessment_id, question_id, list(struct_pack(criterion_id, description, max_marks) order by k) as criteria from ({BODIES["a2_build_rubric"]}) group by all)
  select assessment_id, question_id, text as question_text, answer_text as student_answer, reason, len(criteria)::integer as n, array_to_string(list_transform(criteria, lambda x: x.criterion_id || '/' || x.description || '/' || x.max_marks), ' | ') as criteria
  from {ROUTES} join c using (assessment_id, question_id) where decision in ('LLM_REQUIRED', 'LLM_RECOMMENDED')""")
def s8(s, d):
    from quillmark.sources.ingest import build_requests

    a, rubric = parts(s, d)
    sent = build_requests(routed(a, local_criteria(s, d, a, rubric)), a.select(*KEYS, "text"), a.select(*KEYS, F.col("answer_text").alias("text")), rubric)
    ddl = "question_text string, student_answer string, reason string, criteria array<struct<criterion_id: string, description: string, max_marks: decimal(10,2)>>"
    said = F.transform("p.criteria", lambda c: F.concat_ws("/", c["criterion_id"], c["description"], c["max_marks"]))
    return sent.withColumn("p", F.from_json("payload", ddl)).select(*KEYS, "p.question_text", "p.student_answer", "p.reason", F.size("p.criteria").alias("n"), F.array_join(said, " | ").alias("criteria"))
