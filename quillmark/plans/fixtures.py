"""Exam tables derived from the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

NO_BRACES = str.maketrans("", "", "{}")
EACH = r"EACH\(([^)]*)\)"  # a row for each of some values: the engines name this differently

SQL = {
    # one row for each question of an assessment
    "question_results": """
        select l_orderkey as assessment_id, concat('Q', l_partkey, '-', l_suppkey, '-', l_linenumber) as question_id,
          cast(l_linenumber as string) as question_number, l_linenumber as ord, l_partkey as part, l_suppkey as supp,
          cast(50 as decimal(10,2)) as max_marks,
          cast(case when l_returnflag = 'N' then 0 else l_quantity end as decimal(10,2)) as original_ai_marks,
          cast(case when l_tax >= 0.07 and l_returnflag <> 'N' then least(l_quantity + 5, 50.0) end as decimal(10,2)) as teacher_adjusted_marks,
          cast(case when l_returnflag = 'N' then 0 when l_tax >= 0.07 then least(l_quantity + 5, 50.0) else l_quantity end as decimal(10,2)) as awarded_marks,
          case when l_returnflag = 'N' then 'unanswered' when l_suppkey % 11 = 0 then 'review_required' else 'graded' end as status,
          cast(1 - 5 * l_discount as decimal(4,2)) as evaluation_confidence,
          (l_returnflag <> 'N' and 1 - 5 * l_discount < 0.84) as needs_review,
          case when l_tax >= 0.07 and l_returnflag <> 'N' then 'TEACHER_OVERRIDE' when l_returnflag <> 'N' and 1 - 5 * l_discount < 0.84 then 'PENDING_REVIEW' else 'NOT_REQUIRED' end as review_status,
          case l_suppkey % 3 when 0 then 'local' when 1 then 'local+llm' else 'local_fallback' end as grading_provenance,
          case when l_suppkey % 7 = 0 then 'semantic_ambiguity' end as escalation_reason
        from {lineitem}""",
    # three criteria for each question
    "criterion_evidence": """
        select assessment_id, question_id, question_number, ord, concat('c', k + 1) as criterion_id, k, concat('topic ', (part + k) % 40) as description,
          case (part + 3 * supp + k) % 5 when 0 then 'present' when 1 then 'partially_present' when 2 then 'missing' when 3 then 'contradicted' else 'uncertain' end as status,
          cast(case when k < 2 then 16.67 else 16.66 end as decimal(10,2)) as max_marks,
          cast(0.50 + ((part + supp + 7 * k) % 50) / 100.0 as decimal(4,2)) as confidence,
          case when (part + k) % 4 = 0 then 'Core contradiction identified' else 'Minor contradiction identified' end as notes,
          case (supp + k) % 4 when 0 then 'conflict_flagged' when 1 then 'fused_agreement' else 'local' end as provenance
        from (select *, EACH(0, 1, 2) as k from {question_results})""",
    # proposals of an external evaluator for some criteria, with statuses outside the vocabulary and confidences out of range
    "proposed_evidence": """
        select assessment_id, question_id, case when ord = 5 then 'c9' else criterion_id end as criterion_id,
          case (k + ord) % 6 when 0 then 'PRESENT' when 1 then 'partially_present' when 2 then 'contradicted' when 3 then 'great' when 4 then 'missing' else 'present' end as status,
          cast(cast(confidence as decimal(6,2)) + case when ord = 2 then 0.9 when ord = 3 then -0.9 else 0 end as decimal(6,2)) as confidence,
          case when k = 2 then 'a core mistake in the reasoning' else concat('evidence for ', description) end as evidence, 99.0 as marks
        from {criterion_evidence} where ord % 2 = 1""",
    "assessments": """
        select o_orderkey as assessment_id, o_custkey as student_id, n_name as cohort, r_name as school, o_orderstatus as state
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    # user turns are questions, the turn after them the answer; numbers are written in several ways
    "questions": """
        select conv_id as assessment_id, concat('Q', turn) as id,
          case turn % 5 when 0 then concat('Q', turn, '.') when 2 then concat(' q.', turn, ':') when 4 then concat(turn, '(a)') else cast(turn as string) end as number,
          case turn % 6 when 0 then concat('Define the term. ', text) when 2 then concat('Calculate x = 3 + 4 for 5 marks. ', text) when 4 then concat('Draw and explain the diagram. ', text) else text end as text,
          cast(turn as integer) as order_index, cast(case when turn % 3 = 0 then 0 else turn end as decimal(10,2)) as max_marks,
          case turn % 4 when 0 then 'SECTION-A' when 2 then 'Part B' else '' end as section,
          case when turn % 8 = 0 then 'B' end as correct_option, case when turn % 6 = 2 then '7' when turn % 6 = 4 then 'thre' end as correct_answer
        from {conversations} where role = 'user'""",
    "answers": """
        select conv_id as assessment_id, concat('ans_', turn) as answer_id, cast(turn as integer) as order_index,
          case turn % 5 when 1 then concat('Ans. ', turn - 1) when 3 then concat('Answer: ', turn - 1) when 0 then concat('(', turn - 1, '(a))') else cast(turn + 90 as string) end as question_number,
          case turn % 4 when 1 then concat('x = 3 + 4', chr(10), '= 7 ', text) when 3 then concat('(B) ', text) else text end as text
        from {conversations} where role = 'assistant'""",
    # states of assessments over time
    "status_events": """
        select user_id as assessment_id, event_id, ts, case event_type when 'view' then 'uploaded' when 'click' then 'processing' when 'purchase' then 'completed' when 'signup' then 'grading' else 'failed' end as state, value from {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SQL[name]
    used = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(re.sub(EACH, r"explode(array(\1))", sql), **used)


def duck(sql: str) -> str:
    """Derived-table SQL as DuckDB reads it."""
    return re.sub(EACH, r"unnest([\1])", sql.translate(NO_BRACES))


def with_tables(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` after the derived tables that it names."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in BASE or name in done:
            return
        for n in re.findall(r"\{(\w+)\}", SQL[name]):
            need(n)
        done.append(name)

    for n in names or [n for n in SQL if re.search(rf"\b{n}\b", body)]:
        need(n)
    parts = [f"{n} as ({duck(SQL[n])})" for n in done]
    for begin in ("with recursive ", "with "):
        if parts and body.lstrip().lower().startswith(begin):
            return f"{begin}{', '.join(parts)}, {body.lstrip()[len(begin) :]}"
    return f"with {', '.join(parts)} {body}" if parts else body


# lines of documents as regions of pages of 20, with the numbering that the text lacks
LINES_SPARK = "select doc_id, posexplode(split(text, '\n')) as (ord, line) from {documents}"
LINES_DUCKDB = "select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10)))))::integer as ord from documents"
REGION = """
  select concat('d', doc_id) as document_id, concat('d', doc_id, '_', ord) as region_id, ord, cast(floor(ord / 20) as integer) + 1 as page,
    cast(case when ord % 2 = 0 then 40 else 560 end as double) as x, cast(50 * (ord % 20) as double) as y, cast(least(8 * length(line), 420) as double) as width, cast(30 as double) as height,
    case ord % 7 when 0 then concat(ord, '. Explain ', line) when 1 then concat('(A) ', line) when 2 then concat('(B) ', line) when 3 then concat('(C) ', line) when 4 then concat('(b) ', line) when 6 then concat('SECTION ', cast(ord % 9 as string)) else line end as text,
    case ord % 7 when 0 then 'QUESTION' when 1 then 'OPTION' when 2 then 'OPTION' when 3 then 'OPTION' when 4 then 'SUBQUESTION' when 6 then 'SECTION_HEADER' else 'UNKNOWN' end as role,
    cast(0.5 + (ord % 6) / 10.0 as double) as confidence, case when ord % 8 = 7 then 'UNCERTAIN' else 'VERIFIED' end as state, cast(null as string) as parent_region_id
  from """
REGIONS_DUCKDB = f"with regions as ({REGION}({LINES_DUCKDB}))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"{REGION}({LINES_SPARK})", documents=table(spark, sf_dir, "documents"))


# structures of a model that contend for regions: lost heads, continuations that others have or that are far, boxes only
CONTESTED = """
  select document_id, page, ord, case ord % 7 when 0 then 'QUESTION' when 5 then 'UNKNOWN' else 'OPTION' end as role, cast(0.4 + (ord % 5) / 10.0 as double) as confidence,
    case ord % 7
      when 0 then LIST(region_id, concat(document_id, '_', ord + 5), concat(document_id, '_', ord + 1), concat(document_id, '_', ord + 12), concat(document_id, '_', ord + 4))
      when 1 then LIST(concat(document_id, '_', ord - ord % 2), concat(document_id, '_', ord + 3))
      when 3 then LIST(concat(document_id, '_', ord + 3), concat(document_id, '_', ord + 2))
      when 5 then LIST(concat(document_id, '_', ord - 4), concat(document_id, '_', ord - 1)) end as region_ids,
    x - 3 as x, y - 3 as y, case when ord % 2 = 0 then cast(1100 as double) else width + 6 end as width, case when ord % 7 <> 3 then cast(86 as double) end as height
  from {regions} where ord % 7 in (0, 1, 2, 3, 5)"""
# the structures of both halves of a page, many at the seam, tall enough to reach further once they have grown
HALVES = """
  select document_id, page, ord, case when ord % 3 = 0 then 'QUESTION' else 'OPTION' end as role,
    case when ord % 4 = 1 then LIST(region_id, concat(document_id, '_', ord + 3)) when ord % 9 = 5 then LIST(concat(document_id, '_', ord - 4), region_id) else LIST(region_id) end as region_ids,
    case when ord % 5 = 0 then cast(ord % 2 as string) end as display_number, x, y, width, cast(30 + 30 * (ord % 4) as double) as height, confidence, cast(500 as double) as mid_y
  from {regions}"""
CONTESTED_DUCKDB, HALVES_DUCKDB = (sql.replace("LIST(", "list_value(").translate(NO_BRACES) for sql in (CONTESTED, HALVES))


def contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTESTED.replace("LIST(", "array("), regions=regions(spark, sf_dir))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(top, bottom); the boxes of the bottom ones are relative to the middle."""
    both = spark.sql(HALVES.replace("LIST(", "array("), regions=regions(spark, sf_dir))
    return both.where("y < mid_y"), both.where("y >= mid_y").selectExpr("* except (y)", "y - mid_y as y")
