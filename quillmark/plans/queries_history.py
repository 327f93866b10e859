"""Queries of history, integrity and the event streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions.steps import together
from quillmark.operators import history as H
from quillmark.operators import results as R
from quillmark.plans.entries import query, shared_folder
from quillmark.plans.fixtures import EACH, duck
from quillmark.plans.fixtures import table as T
from quillmark.sources import ingest as I
from quillmark.streaming import events as S

OVERRIDE = """
  select l_orderkey as assessment_id, concat('Q', l_partkey, '-', l_suppkey, '-', l_linenumber) as question_id, l_shipdate as ts, l_partkey * 10 + k as event_id,
    cast(case when (l_partkey + k) % 5 = 0 then 60 when (l_partkey + k) % 7 = 0 then -1 else l_quantity + k end as decimal(10,2)) as teacher_marks, cast(case when l_suppkey % 4 = 0 then l_quantity + k + 1 end as decimal(10,2)) as criterion_sum
  from (select *, EACH(0, 1) as k from {lineitem}) where l_tax >= 0.05"""
REASON = "case when teacher_marks < 0 then 'negative_marks' when teacher_marks > max_marks then 'above_maximum' when abs(criterion_sum - teacher_marks) > 0.05 then 'criteria_do_not_add_up' end"
V = f"(select o.*, {REASON} as reason, original_ai_marks from ({duck(OVERRIDE)}) o join question_results using (assessment_id, question_id))"


def overrides(s, d):
    return s.sql(re.sub(EACH, r"explode(array(\1))", OVERRIDE), lineitem=T(s, d, "lineitem"))


def checked(s, d):
    return H.validate_overrides(overrides(s, d), T(s, d, "question_results"))


@query("h1_validate_overrides", f"select assessment_id, question_id, event_id, teacher_marks, reason from {V}")
def h1(s, d):
    return checked(s, d).select("assessment_id", "question_id", "event_id", "teacher_marks", "reason")


APPLIED = f"select q.assessment_id, q.question_id, q.original_ai_marks, coalesce(m, q.teacher_adjusted_marks) as teacher_adjusted_marks, coalesce(m, q.awarded_marks) as awarded_marks, case when m is not null then 'TEACHER_OVERRIDE' else q.review_status end as review_status, max_marks from question_results q left join (select assessment_id, question_id, max_by(teacher_marks, event_id) m from {V} where reason is null group by 1, 2) using (assessment_id, question_id)"


@query("h2_apply_overrides", f"select assessment_id, question_id, original_ai_marks, teacher_adjusted_marks, awarded_marks, review_status from ({APPLIED})")
def h2(s, d):
    return H.apply_overrides(T(s, d, "question_results"), checked(s, d)).select("assessment_id", "question_id", "original_ai_marks", "teacher_adjusted_marks", "awarded_marks", "review_status")


@query("h4_audit_trail", f"select assessment_id, question_id, event_id, coalesce(lag(teacher_marks) over (partition by assessment_id, question_id order by event_id), original_ai_marks) as previous_value, teacher_marks as new_value, (row_number() over (partition by assessment_id order by ts, event_id))::integer as sequence from {V} where reason is null")
def h4(s, d):
    return H.audit_trail(H.override_audit(checked(s, d), T(s, d, "question_results"))).select("assessment_id", "question_id", "event_id", "previous_value", "new_value", "sequence")


def finals(s, d):
    return T(s, d, "status_events").where("state = 'completed'").select("assessment_id", "ts", "event_id")


def totals(s, d):
    return R.recalculated_totals(H.apply_overrides(T(s, d, "question_results"), checked(s, d)))


@query("h3_finalize", f"select assessment_id, (sum(awarded_marks))::decimal(10,2) as final_awarded_marks, any_value(r) as revision_index from ({APPLIED}) join (select assessment_id, count(*)::integer r from status_events where state = 'completed' group by 1) using (assessment_id) group by 1")
def h3(s, d):
    return H.finalize(totals(s, d), finals(s, d))[0].select("assessment_id", "final_awarded_marks", "revision_index")


def stored(s, d):
    """Snapshots of every finalisation: each revision of the totals as they are."""
    done, log = H.finalize(totals(s, d), finals(s, d))
    every = done.drop("revision_index").join(log.select("assessment_id", "revision_index"), "assessment_id")
    return H.snapshots(every)


@query("s6_write_snapshots", "select 0::bigint as written_again, (select count(*) from status_events where state = 'completed' and assessment_id in (select assessment_id from question_results)) as written")
def s6(s, d):
    path = f"{shared_folder(s)}/snapshots-{uuid.uuid4().hex}"
    I.append_events(stored(s, d), path)
    known = I.read_results(s, path)
    done, log = H.finalize(totals(s, d), finals(s, d))
    again = H.snapshots(done.drop("revision_index").join(log.select("assessment_id", "revision_index"), "assessment_id"), known)
    return again.select(F.lit(1).alias("again")).unionByName(known.select(F.lit(0).alias("again"))).agg(F.count_if(F.col("again") == 1).alias("written_again"), F.count_if(F.col("again") == 0).alias("written"))


@query("p27_canonical_hash", """select assessment_id, question_id, sha256('{"assessment_id":' || assessment_id || ',"criteria":[' || string_agg('{"confidence":' || confidence || ',"id":"' || criterion_id || '","note":' || case when k = 1 then 'null' else '{"by":"' || provenance || '","text":"' || notes || '"}' end || '}', ',' order by k, case when k <> 1 then notes end, provenance, confidence) || '],"marks":{' || string_agg(distinct '"' || criterion_id || '":' || max_marks, ',' order by '"' || criterion_id || '":' || max_marks) || '},"question_id":"' || question_id || '"}') as hash
  from criterion_evidence group by 1, 2""")
def p27(s, d):
    """A nested payload whose fields and keys come in another order than that of their names."""
    note = F.when(F.col("k") != 1, F.struct(F.col("notes").alias("text"), F.col("provenance").alias("by")))
    given = T(s, d, "criterion_evidence").select("question_id", "assessment_id", "k", "notes", "provenance", "criterion_id", "confidence", "max_marks")
    rows = together(given, "question_id", "assessment_id").groupBy("question_id", "assessment_id").agg(
        F.array_sort(F.collect_list(F.struct("k", note.alias("note"), F.when(F.col("k") == 1, F.col("provenance")).alias("by"), F.col("criterion_id").alias("id"), "confidence"))).alias("c"), F.map_from_entries(F.reverse(F.array_sort(F.collect_set(F.struct("criterion_id", "max_marks"))))).alias("marks"))
    rows = rows.withColumn("criteria", F.transform("c", lambda c: F.struct(c["note"].alias("note"), c["id"].alias("id"), c["confidence"].alias("confidence"))))
    return rows.select("assessment_id", "question_id", H.canonical_hash(rows, "question_id", "marks", "criteria", "assessment_id").alias("hash"))


# payloads of every shape
PAYLOADS = """case event_id % 7 when 0 then props when 1 then concat('{"marks": {"final": ', event_id % 50, '.5, "by": "', event_type, '"}, "ids": [', event_id, ', 7]}') when 2 then concat('[', event_id, ', "', event_type, '"]')
  when 3 then concat('"', event_type, '"') when 4 then cast(event_id as string) when 5 then case when event_id % 2 = 0 then 'true' else 'null' end else concat('not json ', event_id) end"""


@query("h4_audit_payloads", f"""with e as (select event_id, user_id, ts, ({PAYLOADS}) as p from events), j as (select *, case when json_valid(p) then p::json end as v from e)
  select event_id, case when v is null then 'none' else case json_type(v) when 'OBJECT' then 'object' when 'ARRAY' then 'list' when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end end as kind, case when v is null then p end as raw,
    try_cast(v ->> '$.k' as integer) as k, try_cast(v ->> '$.marks.final' as double) as final, v ->> '$.marks.by' as by_whom, try_cast(v ->> '$.ids[0]' as bigint) as first_id, coalesce(lag(case when v is null then 'none' else 'json' end) over (partition by user_id order by ts, event_id), 'first') as before
  from j""")
def h4p(s, d):
    """Written with a VARIANT column and read back."""
    path = f"{shared_folder(s)}/audit-{uuid.uuid4().hex}"
    e = T(s, d, "events").select("event_id", "user_id", "ts", F.expr(PAYLOADS).alias("new_value"))
    I.append_events(H.typed_events(e, "new_value"), path)
    v = F.col("new_value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.coalesce(F.lag(F.when(v.isNull(), "none").otherwise("json")).over(w), F.lit("first"))
    return I.read_results(s, path).select("event_id", H.payload_kind(v).alias("kind"), F.col("new_value_text").alias("raw"), H.payload_at(v, "$.k", "int").alias("k"), H.payload_at(v, "$.marks.final", "double").alias("final"), H.payload_at(v, "$.marks.by", "string").alias("by_whom"), H.payload_at(v, "$.ids[0]", "long").alias("first_id"), before.alias("before"))


@query("h5_revision_history", "select assessment_id, (row_number() over (partition by assessment_id order by ts, event_id))::integer as revision_index from status_events where state = 'completed' and assessment_id in (select assessment_id from question_results)")
def h5(s, d):
    return H.revision_history(stored(s, d)).select("assessment_id", "revision_index")


@query("h5_snapshot_as_of", f"""with f as (select assessment_id, count(*)::integer as n from status_events where state = 'completed' group by 1), t as (select assessment_id, sum(awarded_marks)::decimal(10,2) as marks from ({APPLIED}) group by 1)
  select assessment_id, 2 as revision_index, t.assessment_id is not null and n >= 2 as from_snapshot, marks, case when n >= 2 and t.assessment_id is not null then '2' end as revision from f left join t using (assessment_id)""")
def h5a(s, d):
    kept = stored(s, d)
    now = totals(s, d).select("assessment_id", F.to_json(F.struct("assessment_id", "final_awarded_marks")).alias("payload"))
    wanted = finals(s, d).select("assessment_id").distinct().withColumn("revision_index", F.lit(2))
    rows = H.snapshot_as_of(kept, now, wanted)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return rows.select("assessment_id", "revision_index", "from_snapshot", field("final_awarded_marks").cast("decimal(10,2)").alias("marks"), field("revision_index").alias("revision"))


@query("h6_verify_snapshots", "with c as (select assessment_id, (row_number() over (partition by assessment_id order by ts, event_id))::integer as revision_index from status_events where state = 'completed' and assessment_id in (select assessment_id from question_results)) select assessment_id, revision_index, case when revision_index = 2 then 'hash_mismatch' else 'missing' end as problem from c where revision_index in (2, 3)")
def h6(s, d):
    kept = stored(s, d)
    broken = kept.where("revision_index <> 3").withColumn("payload", F.when(F.col("revision_index") == 2, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return H.verify_snapshots(broken, kept)


@query("j26_apply_criterion_overrides", "select assessment_id, question_id, criterion_id, case when ord % 2 = 1 or k = 2 then status when k = 0 then 'present' else 'missing' end as status, case when ord % 2 = 1 or k = 2 then 1.00 when k = 0 then max_marks else 0.00 end::decimal(10,2) as awarded_marks from criterion_evidence")
def j26(s, d):
    c = T(s, d, "criterion_evidence").withColumn("awarded_marks", F.lit(1).cast("decimal(10,2)"))
    o = c.where("ord % 2 = 0 and k < 2").select("assessment_id", "question_id", "criterion_id", F.when(F.col("k") == 0, F.col("max_marks")).otherwise(0).cast("decimal(10,2)").alias("marks"))
    return H.apply_criterion_overrides(c, o).select("assessment_id", "question_id", "criterion_id", "status", "awarded_marks")


@query("s7_write_report", f"""select assessment_id, revision_index, marks, count(*) as questions, string_agg(concat_ws('/', ord, question_id, question_number, awarded_marks, max_marks, status), ' | ' order by ord, question_id) as listed
  from question_results join (select assessment_id, 1 as revision_index, sum(awarded_marks)::decimal(10,2)::varchar as marks from ({APPLIED}) group by 1) using (assessment_id) group by 1, 2, 3""")
def s7(s, d):
    """Reports as JSON, read back field by field."""
    path = f"{shared_folder(s)}/report-{uuid.uuid4().hex}"
    I.write_report(I.report_rows(totals(s, d), T(s, d, "question_results"), F.lit(1)), path)
    ddl = "assessment_id long, revision_index int, final_awarded_marks decimal(10,2), questions array<struct<ord: int, question_id: string, question_number: string, awarded_marks: decimal(10,2), max_marks: decimal(10,2), status: string>>"
    said = F.transform("questions", lambda q: F.concat_ws("/", q["ord"], q["question_id"], q["question_number"], q["awarded_marks"], q["max_marks"], q["status"]))
    return s.read.schema(ddl).json(path).select("assessment_id", "revision_index", F.col("final_awarded_marks").cast("string").alias("marks"), F.size("questions").cast("long").alias("questions"), F.array_join(said, " | ").alias("listed"))


def stream(s, d):
    return S.read_events(s, f"{d}/event[s].parquet")


def status(df):
    return df.select(F.col("user_id").alias("assessment_id"), "event_id", "ts", F.expr("case event_type when 'view' then 'uploaded' when 'click' then 'processing' when 'purchase' then 'completed' when 'signup' then 'grading' else 'failed' end").alias("state"))


def folder(s):
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


@query("t1_latest_status", "select assessment_id, arg_max(state, (ts, event_id)) as state, case arg_max(state, (ts, event_id)) when 'uploaded' then 0.05 when 'processing' then 0.10 when 'grading' then 0.70 else 1.0 end::double as progress from status_events group by 1")
def t1(s, d):
    return S.run_now(S.latest_status(status(stream(s, d))), folder(s), "complete").select("assessment_id", "state", "progress")


# event by event of each assessment, up to the watermark: since when the run goes on, and which ones were over
@query("t2_stuck_assessments", f"""with recursive w as (select *, (select max(ts) from status_events) - interval 10 minutes as mark from status_events),
  e as (select assessment_id, ts, state, row_number() over (partition by assessment_id order by ts, event_id) n from w where ts <= mark),
  ends as (select assessment_id, ts, state, n from e union all select assessment_id, (select any_value(mark) from w), '', max(n) + 1 from e group by 1),
  f as (select distinct assessment_id, 0::bigint n, null::timestamp since, null::timestamp lost from ends
    union all select assessment_id, n, case when state = 'processing' then coalesce(since, ts) when state in ('completed', 'failed') then null else since end, lost
    from (select e.assessment_id, e.n, e.ts, e.state, case when e.ts - f.since > interval {S.LIMIT_S} seconds then f.since end as lost, case when e.ts - f.since > interval {S.LIMIT_S} seconds then null else f.since end as since
      from f join ends e on e.assessment_id = f.assessment_id and e.n = f.n + 1))
  select assessment_id, lost as started, 'failed' as state from f where lost is not null""")
def t2(s, d):
    return S.run_now(S.stuck_assessments(status(stream(s, d))), folder(s))


@query("t3_live_totals", "select user_id as assessment_id, sum(m::decimal(18,2))::double as marks, count(*) as questions from (select user_id, event_type, arg_max(value, (ts, event_id)) m from events group by 1, 2) group by 1")
def t3(s, d):
    e = stream(s, d).select(F.col("user_id").alias("assessment_id"), F.col("event_type").alias("question_id"), "ts", "event_id", F.col("value").cast("decimal(18,2)").alias("marks"))
    return S.run_updates(S.live_totals(e), folder(s), "assessment_id").select("assessment_id", F.col("marks").cast("double").alias("marks"), "questions")


@query("t4_audit_rates", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def t4(s, d):
    return S.run_now(S.audit_rates(stream(s, d)), folder(s), "complete")


@query("t5_dedupe_events", "select count(distinct event_id) as n from events")
def t5(s, d):
    e = stream(s, d)
    return S.run_now(S.dedupe_events(e.union(e)), folder(s)).agg(F.count("*").alias("n"))
