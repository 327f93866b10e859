"""Queries over question results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import grading as G
from quillmark.operators import results as R
from quillmark.plans.entries import joined, query
from quillmark.plans.fixtures import table

T = table
BAND = "case when {p} >= 90 then 'Outstanding' when {p} >= 75 then 'Proficient' when {p} >= 50 then 'Developing' else 'Needs Support' end"
M = "round_even(cast({x} as decimal(12,3)), 2)::decimal(10,2)"
Q, E = "question_results", "criterion_evidence"
TOTALS = f"""
  select assessment_id, coalesce(n, 0)::bigint as total_questions, coalesce(a, 0)::bigint as answered_questions, coalesce(u, 0)::bigint as unanswered_questions, coalesce(rev, 0)::bigint as questions_needing_review,
    coalesce(lo, 0)::bigint as local_only_questions, coalesce(ll, 0)::bigint as llm_assisted_questions, coalesce(fb, 0)::bigint as fallback_questions,
    coalesce(mx, 0)::decimal(10,2) as total_max_marks, coalesce(ai, 0)::decimal(10,2) as ai_awarded_marks, tm::decimal(10,2) as teacher_adjusted_marks, coalesce(fin, 0)::decimal(10,2) as final_awarded_marks,
    coalesce({M.format(x='100 * fin / mx')}, 0)::decimal(10,2) as percentage, {M.format(x='coalesce(conf, 0)')} as overall_confidence
  from (select o_orderkey as assessment_id from orders) left join (
    select assessment_id, count(*) n, count(*) filter (status <> 'unanswered') a, count(*) filter (status = 'unanswered') u, sum(max_marks) mx, sum(original_ai_marks) ai, sum(awarded_marks) fin, sum(teacher_adjusted_marks) tm,
      avg(evaluation_confidence) conf, count(*) filter (needs_review or review_status in ('PENDING_REVIEW', 'TEACHER_OVERRIDE')) rev, count(*) filter (grading_provenance = 'local') lo, count(*) filter (grading_provenance = 'local+llm') ll, count(*) filter (grading_provenance = 'local_fallback') fb
    from question_results group by 1) using (assessment_id)"""


@query("a4_assessment_totals", f"select *, {BAND.format(p='percentage')} as performance_band from ({TOTALS})")
def a4(s, d):
    return R.assessment_totals(T(s, d, "orders").select(F.col("o_orderkey").alias("assessment_id")), T(s, d, Q))


@query("p26_performance_band", f"select performance_band, count(*) as n from (select {BAND.format(p='percentage')} as performance_band from ({TOTALS})) group by 1")
def p26(s, d):
    return a4(s, d).groupBy("performance_band").agg(F.count("*").alias("n"))


@query("a5_recalculated_totals", f"""
  select assessment_id, case when o > 0 then fin end::decimal(10,2) as teacher_adjusted_marks, fin::decimal(10,2) as final_awarded_marks, {M.format(x='100 * fin / mx')} as percentage
  from (select assessment_id, sum(max_marks) mx, sum(coalesce(teacher_adjusted_marks, original_ai_marks)) fin, count(teacher_adjusted_marks) o from question_results group by 1)""")  # fmt: skip
def a5(s, d):
    return R.recalculated_totals(T(s, d, Q))


REASONS = """
  select assessment_id, question_id, question_number, max_marks, awarded_marks, evaluation_confidence,
    case when status = 'review_required' then 'mapping_uncertainty' when conflict then 'llm_disagreement' when contra then 'contradiction' when unc then 'uncertain_evidence' when evaluation_confidence < 0.55 then 'low_confidence' else coalesce(escalation_reason, 'teacher_requested_review') end as review_reason,
    review_status, teacher_adjusted_marks is not null as has_teacher_override
  from question_results left join (select assessment_id, question_id, bool_or(provenance = 'conflict_flagged') conflict, bool_or(status = 'contradicted') contra, bool_or(status = 'uncertain') unc from criterion_evidence group by 1, 2) using (assessment_id, question_id)
  where needs_review or review_status in ('PENDING_REVIEW', 'TEACHER_OVERRIDE')"""


@query("a6_review_queue", REASONS)
def a6(s, d):
    return R.review_reasons(T(s, d, Q), T(s, d, E))


@query("a6_review_breakdown", f"select assessment_id, sum(n)::bigint as pending_count, string_agg(review_reason || ':' || n, ',' order by review_reason) as breakdown from (select assessment_id, review_reason, count(*) n from ({REASONS}) group by 1, 2) group by 1")
def a6b(s, d):
    b = R.review_breakdown(a6(s, d))
    return b.select("assessment_id", "pending_count", F.array_join(F.transform(F.map_entries("review_reasons_breakdown"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("breakdown"))


SAID = "coalesce(string_agg({x}, ' | ' order by k) filter (status {w}), '')"
FEEDBACK = f"""
  select assessment_id, question_id, {SAID.format(x="'Demonstrated solid understanding of ''' || description || '''.'", w="= 'present'")} as strengths,
    {SAID.format(x="'Elaborate further on ''' || description || ''' to earn full marks.'", w="= 'partially_present'")} as areas_to_improve,
    {SAID.format(x="'Missing required concept: ''' || description || '''.'", w="= 'missing'")} as missing_concepts,
    {SAID.format(x="'Incorrect/contradictory statement regarding ''' || description || '''.'", w="= 'contradicted'")} as corrections
  from criterion_evidence group by 1, 2"""


@query("a7_question_feedback", f"""
  select assessment_id, question_id, s as strengths, areas_to_improve, m as missing_concepts, corrections,
    trim('Score: ' || awarded_marks || '/' || max_marks || '. ' || case when s <> '' then ' Strengths: ' || replace(s, ' | ', ' ') else '' end || case when m <> '' then ' Missing: ' || replace(m, ' | ', ' ') else '' end || case when areas_to_improve <> '' then ' Improve: ' || replace(areas_to_improve, ' | ', ' ') else '' end || case when corrections <> '' then ' Corrections: ' || replace(corrections, ' | ', ' ') else '' end) as feedback_text
  from (select f.*, q.awarded_marks, q.max_marks, case when strengths || areas_to_improve || missing_concepts || corrections = '' and status <> 'unanswered' then 'Answer provided.' else strengths end s,
      case when strengths || areas_to_improve || missing_concepts || corrections = '' and status = 'unanswered' then 'No response submitted for this question.' else missing_concepts end m
    from question_results q join ({FEEDBACK}) f using (assessment_id, question_id))""")  # fmt: skip
def a7(s, d):
    return joined(R.question_feedback(T(s, d, Q), T(s, d, E)), "strengths", "areas_to_improve", "missing_concepts", "corrections")


@query("a8_assessment_feedback", """
  with q as (select *, awarded_marks >= max_marks * 0.8 as strong, awarded_marks <= max_marks * 0.4 and not awarded_marks >= max_marks * 0.8 as weak, 'Q' || question_number || ' (' || awarded_marks || '/' || max_marks || ')' as score from question_results),
  t as (select c.assessment_id, (list('Q' || c.question_number || ': ' || description order by c.ord, c.question_id, k))[:5] as l from criterion_evidence c join q using (assessment_id, question_id) where weak and c.status in ('missing', 'contradicted') group by 1)
  select assessment_id, coalesce(array_to_string((list('Strong performance on ' || score order by ord, question_id) filter (strong))[:4], ' | '), '') as strengths,
    coalesce(array_to_string((list('Needs improvement on ' || score order by ord, question_id) filter (weak))[:4], ' | '), '') as areas_for_improvement, coalesce(array_to_string(any_value(t.l), ' | '), '') as topics_requiring_attention
  from q left join t using (assessment_id) group by 1""")  # fmt: skip
def a8(s, d):
    return joined(R.assessment_feedback(T(s, d, Q), T(s, d, E)), "strengths", "areas_for_improvement", "topics_requiring_attention")


@query("a9_student_feedback", """
  with r as (
    select assessment_id, ord, question_id, k, case when status = 'present' then 'Q' || question_number || ': Mastered ''' || description || '''.' end st,
      case when status in ('missing', 'contradicted') then 'Q' || question_number || ': Missing concept ''' || description || '''.' when status = 'partially_present' then 'Q' || question_number || ': Partial evidence for ''' || description || '''.' end we,
      case when status in ('missing', 'contradicted') then 'Review ''' || description || ''' for Q' || question_number || ' to strengthen core concept mastery.' when status = 'partially_present' then 'Elaborate further on ''' || description || ''' in Q' || question_number || '.' end re
    from criterion_evidence union all
    select assessment_id, ord, question_id, 99, null, 'Q' || question_number || ' was unanswered.', 'Ensure all questions are attempted, including Q' || question_number || '.' from question_results where status = 'unanswered')
  select assessment_id, coalesce(array_to_string((list(st order by ord, question_id, k) filter (st is not null))[:6], ' | '), '') as strengths, coalesce(array_to_string((list(we order by ord, question_id, k) filter (we is not null))[:6], ' | '), '') as weaknesses, coalesce(array_to_string((list(re order by ord, question_id, k) filter (re is not null))[:6], ' | '), '') as recommendations
  from r group by 1""")  # fmt: skip
def a9(s, d):
    return joined(R.student_feedback(T(s, d, Q), T(s, d, E)), "strengths", "weaknesses", "recommendations")


@query("a10_question_insights", """
  select assessment_id, question_id, case when q.status = 'unanswered' then '' else coalesce(string_agg('Q' || q.question_number || ': Correctly demonstrated ''' || description || '''.', ' | ' order by k) filter (e.status = 'present'), '') end as strengths,
    case when q.status = 'unanswered' then 'Q' || q.question_number || ' was left unanswered.' else coalesce(string_agg('Q' || q.question_number || case when e.status = 'partially_present' then ': Partial evidence for ''' || description || '''.' when e.status = 'uncertain' then ': Evidence for ''' || description || ''' is inconclusive and may require review.' else ': Missing required concept ''' || description || '''.' end, ' | ' order by k) filter (e.status <> 'present'), '') end as improvement_areas,
    case when q.status = 'unanswered' then 'q:' || question_id || ':unanswered' else string_agg('q:' || question_id || ':c:' || criterion_id, ' | ' order by k) end as evidence_refs, (case when q.status = 'unanswered' then 1 else evaluation_confidence end)::decimal(4,2) as confidence
  from question_results q join criterion_evidence e using (assessment_id, question_id) group by assessment_id, question_id, q.status, q.question_number, evaluation_confidence""")  # fmt: skip
def a10(s, d):
    return joined(R.question_insights(T(s, d, Q), T(s, d, E)), "strengths", "improvement_areas", "evidence_refs")


@query("a11_error_patterns", """
  with p as (select e.assessment_id, case e.status when 'missing' then 'CONCEPTUAL_GAP' when 'partially_present' then 'PARTIAL_CONCEPT' else 'MISCONCEPTION' end as pattern, question_id from criterion_evidence e join question_results q using (assessment_id, question_id) where q.status <> 'unanswered' and e.status in ('missing', 'partially_present', 'contradicted')
    union all select assessment_id, 'UNANSWERED_PATTERN', question_id from question_results where status = 'unanswered')
  select assessment_id, pattern, count(*) as occurrences, string_agg(distinct question_id, ' | ' order by question_id) as question_ids,
    case when count(*) >= 2 then 'Recurring pattern observed: ' else 'Observed issue: ' end || case pattern when 'CONCEPTUAL_GAP' then 'Conceptual Gap' when 'PARTIAL_CONCEPT' then 'Partial Concept' when 'MISCONCEPTION' then 'Misconception' else 'Unanswered Pattern' end as title from p group by 1, 2""")  # fmt: skip
def a11(s, d):
    return joined(R.error_patterns(T(s, d, Q), T(s, d, E)), "question_ids")


@query("a12_review_priorities", "select assessment_id, 'prio_' || question_id as insight_id, 'Q' || question_number || ' is flagged for teacher review (Status: ' || review_status || ', Confidence: ' || round_even(evaluation_confidence * 100, 0)::integer || '%).' as summary, evaluation_confidence as confidence from question_results where status <> 'unanswered' and (review_status <> 'NOT_REQUIRED' or needs_review)")
def a12(s, d):
    return R.review_priorities(T(s, d, Q))


@query("a13_question_summary", f"select assessment_id, question_id, max_marks, awarded_marks as final_awarded_marks, {M.format(x='100 * awarded_marks / max_marks')} as percentage, status, review_status, criteria from question_results join (select assessment_id, question_id, string_agg(criterion_id || '=' || status, ' | ' order by k) as criteria from criterion_evidence group by 1, 2) using (assessment_id, question_id)")
def a13(s, d):
    return R.question_summary(T(s, d, Q), T(s, d, E)).withColumn("criteria", F.array_join(F.transform("criteria", lambda c: F.concat(c["criterion_id"], F.lit("="), c["status"])), " | "))


@query("a13_student_summary", f"select assessment_id, total_max_marks, final_awarded_marks, percentage, answered_questions, unanswered_questions, questions_needing_review, {BAND.format(p='percentage')} as performance_band from ({TOTALS})")
def a13s(s, d):
    return a4(s, d).select("assessment_id", "total_max_marks", "final_awarded_marks", "percentage", "answered_questions", "unanswered_questions", "questions_needing_review", "performance_band")


@query("a14_confidence_bands", "select assessment_id, count(*) filter (evaluation_confidence >= 0.85) as high, count(*) filter (evaluation_confidence >= 0.6 and evaluation_confidence < 0.85) as medium, count(*) filter (evaluation_confidence < 0.6) as low from question_results group by 1")
def a14(s, d):
    return R.confidence_bands(T(s, d, Q))


@query("a14_criterion_mastery", "select assessment_id, count(*) as criteria, " + ", ".join(f"count(*) filter ({c}) as n_{k}, " + M.format(x=f"100 * (count(*) filter ({c})) / count(*)") + f" as pct_{k}" for k, c in (("present", "status = 'present'"), ("partial", "status = 'partially_present'"), ("missing", "status in ('missing', 'contradicted')"))) + " from criterion_evidence group by 1")
def a14m(s, d):
    return R.criterion_mastery(T(s, d, E))


@query("a15_list_assessments", "select o_orderkey as assessment_id, o_orderstatus as state, coalesce(n, 0) as questions, coalesce(m, 0) as matched, coalesce(u, 0) as unanswered, coalesce(r, 0) as review from orders left join (select assessment_id, count(*) n, count(*) filter (status = 'graded') m, count(*) filter (status = 'unanswered') u, count(*) filter (status = 'review_required') r from question_results group by 1) on o_orderkey = assessment_id")
def a15(s, d):
    return R.list_assessments(T(s, d, "orders").selectExpr("o_orderkey as assessment_id", "o_orderstatus as state"), T(s, d, Q))


@query("f1_question_filter", "select 'NEEDS_REVIEW' as tab, assessment_id, question_id from question_results where needs_review or review_status = 'PENDING_REVIEW' union all select 'UNANSWERED', assessment_id, question_id from question_results where status = 'unanswered' union all select 'OVERRIDDEN', assessment_id, question_id from question_results where review_status = 'TEACHER_OVERRIDE' union all select 'HIGH_CONFIDENCE', assessment_id, question_id from question_results where evaluation_confidence >= 0.85 and not needs_review union all select 'ALL', assessment_id, question_id from question_results")
def f1(s, d):
    q = T(s, d, Q)
    parts = [R.question_filter(q, tab).select(F.lit(tab).alias("tab"), "assessment_id", "question_id") for tab in R.TABS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("f2_question_search", "select assessment_id, id, number from questions where contains(lower(number), '2.') or contains(lower(text), '2.') or contains(lower(text), 'calculate')")
def f2(s, d):
    q = T(s, d, "questions")
    return R.question_search(q, "2.").union(R.question_search(q, " Calculate ")).select("assessment_id", "id", "number").distinct()


@query("u3_attention_list", "select distinct assessment_id, question_id from question_results where status in ('unanswered', 'review_required') or needs_review")
def u3(s, d):
    return R.attention_list(T(s, d, Q))


@query("n4_criterion_sum", "select assessment_id, question_id, case when bool_and(try_cast(m as decimal(10,2)) is not null) then least(sum(try_cast(m as decimal(10,2))), sum(max_marks)) end::decimal(10,2) as marks from (select *, case when ord = 3 and k = 1 then 'n/a' else cast(max_marks as varchar) end m from criterion_evidence) group by 1, 2")
def n4(s, d):
    return R.criterion_sum(T(s, d, E).withColumn("marks", F.when((F.col("ord") == 3) & (F.col("k") == 1), "n/a").otherwise(F.col("max_marks").cast("string"))))


@query("w11_first_messages", "select assessment_id, array_to_string((list(description order by ord, question_id, k) filter (status = 'missing'))[:5], ' | ') as messages from criterion_evidence group by 1 having count(*) filter (status = 'missing') > 0")
def w11(s, d):
    return joined(R.first_messages(T(s, d, E).where("status = 'missing'").withColumn("message", F.col("description")), 5), "messages")


@query("w12_spanned_pages", "with p as (select distinct l_orderkey as assessment_id, concat('a', l_partkey % 3) as answer_id, (l_suppkey % 9 + 1) as page from lineitem) select assessment_id, answer_id, page, lag(page) over w as previous_page, lead(page) over w as next_page from p window w as (partition by assessment_id, answer_id order by page)")
def w12(s, d):
    return R.spanned_pages(T(s, d, "lineitem").selectExpr("l_orderkey as assessment_id", "concat('a', l_partkey % 3) as answer_id", "l_suppkey % 9 + 1 as page"))


@query("p30_explain_question", """
  select assessment_id, question_id, coalesce(string_agg('Satisfied criterion ''' || description || ''' (' || aw || '/' || max_marks || ' marks)', ' | ' order by k) filter (status = 'present'), '') as strengths,
    coalesce(string_agg('Partial credit for ''' || description || ''' (' || aw || '/' || max_marks || ' marks)', ' | ' order by k) filter (status = 'partially_present'), '') as partial_points,
    coalesce(string_agg(case when status = 'missing' then 'Missing required concept ''' || description || ''' (0/' || max_marks || ' marks)' else 'Contradiction identified in ''' || description || ''' (' || notes || ')' end, ' | ' order by k) filter (status in ('missing', 'contradicted')), '') as missing_points
  from (select *, round_even(cast(max_marks * (case status when 'present' then 1.00 when 'partially_present' then 0.60 else 0.00 end) as decimal(12,3)), 2)::decimal(10,2) aw from criterion_evidence) group by 1, 2""")  # fmt: skip
def p30(s, d):
    return joined(R.explain_questions(T(s, d, E).withColumn("awarded_marks", G.criterion_credit(F.col("status"), F.col("notes"), F.col("max_marks")))), "strengths", "partial_points", "missing_points")


@query("n1_pack_nested", "select assessment_id, count(*) as questions, string_agg(question_id || ':' || n, ',' order by ord, question_id) as packed from (select assessment_id, question_id, ord, count(*) n from criterion_evidence group by 1, 2, 3) group by 1")
def n1(s, d):
    q = T(s, d, E).groupBy("assessment_id", "question_id", "ord").agg(F.collect_list(F.struct("k", "criterion_id")).alias("criteria"))
    nested = q.groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct("ord", "question_id", "criteria"))).alias("q"))
    return nested.select("assessment_id", F.size("q").cast("long").alias("questions"), F.array_join(F.transform("q", lambda x: F.concat(x["question_id"], F.lit(":"), F.size(x["criteria"]))), ",").alias("packed"))


@query("f11_viewer_regions", "select l_orderkey as assessment_id, concat('Q', l_partkey, '-', l_suppkey, '-', l_linenumber) as question_id, case when l_returnflag = 'N' then 0 else 1 end as n_regions, case when l_returnflag = 'N' then null when l_linenumber % 2 = 0 then 1 else l_linenumber end as page from lineitem")
def f11(s, d):
    rows = T(s, d, "lineitem").selectExpr("l_orderkey as assessment_id", "concat('Q', l_partkey, '-', l_suppkey, '-', l_linenumber) as question_id", "l_returnflag = 'N' as unanswered", "array(named_struct('page', if(l_linenumber % 2 = 0, null, l_linenumber), 'x', cast(null as double))) as regions")
    seen = viewer_regions(rows)
    return seen.select("assessment_id", "question_id", F.size("regions").alias("n_regions"), F.get("regions", F.lit(0))["page"].alias("page"))


def viewer_regions(rows):
    """No region for an unanswered question; a null page is 1, a null coordinate 0."""
    fixed = F.transform("regions", lambda r: F.struct(F.coalesce(r["page"], F.lit(1)).alias("page"), F.coalesce(r["x"], F.lit(0.0)).alias("x")))
    return rows.withColumn("regions", F.when(F.col("unanswered"), F.slice(fixed, 1, 0)).otherwise(fixed))
