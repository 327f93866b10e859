"""Queries of ingest, matching and similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmark.operators import matching as MT
from quillmark.plans.entries import query, shared_folder
from quillmark.plans.fixtures import table as T
from quillmark.sources import ingest as I

REF = "nullif(regexp_replace(regexp_replace(trim(regexp_replace(trim({c}), '^(answer[.:]?|ans[.:]?|q[.:]?)\\s*', '', 'i')), '^[.: -]+|[.: -]+$', '', 'g'), '^\\(([^(]*)\\)$', '\\1'), '')"
NUM = "trim(regexp_replace(case when regexp_matches(trim({c}), '^[qQ]') then regexp_replace(trim(trim({c})[2:]), '^\\.+', '') else trim({c}) end, '[.:-]+$', ''))"
MATCH = f"""
  select q.assessment_id, q.id as question_id, count(*) as n_answers, min_by(a.answer_id, a.order_index) as answer_id, string_agg(a.text, chr(10) order by a.order_index) filter (a.text <> '') as text, list(a.answer_id) as ids
  from questions q join answers a on q.assessment_id = a.assessment_id and lower({REF.format(c='q.number')}) = lower({REF.format(c='a.question_number')}) group by 1, 2"""


@query("p1_clean_question_number", f"select assessment_id, id, {NUM.format(c='number')} as clean from questions")
def p1(s, d):
    return T(s, d, "questions").select("assessment_id", "id", I.clean_question_number(F.col("number"), F.col("order_index") + 1).alias("clean"))


@query("p2_clean_answer_ref", f"select assessment_id, answer_id, {REF.format(c='question_number')} as clean from answers")
def p2(s, d):
    return T(s, d, "answers").select("assessment_id", "answer_id", I.clean_answer_ref(F.col("question_number")).alias("clean"))


BOX = "l_partkey % 900 as ymin, l_suppkey % 800 as xmin, l_partkey % 900 + l_linenumber * 20 as ymax, l_suppkey % 800 + l_linenumber * 20 as xmax"


@query("p3_normalized_box", f"select l_orderkey as assessment_id, l_partkey as part, l_suppkey as supp, l_linenumber as n, round_even(greatest(0, least(xmin / 1000 * 1240, 1239))::double, 1) as x, round_even(greatest(0, least(ymin / 1000 * 1754, 1753))::double, 1) as y from (select *, {BOX} from lineitem)")
def p3(s, d):
    rows = T(s, d, "lineitem").selectExpr("*", *BOX.split(", "))
    box = F.array(*(F.col(c).cast("double") for c in ("ymin", "xmin", "ymax", "xmax")))
    b = I.normalized_box(box, F.lit(1240.0), F.lit(1754.0), "answer")
    return rows.select(F.col("l_orderkey").alias("assessment_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("n"), b["x"].alias("x"), b["y"].alias("y"))


@query("p4_xyxy_to_bbox", "select l_orderkey as assessment_id, l_partkey as part, l_suppkey as supp, l_linenumber as n, least(l_partkey, l_suppkey)::double as x, abs(l_suppkey - l_partkey)::double as width from lineitem")
def p4(s, d):
    b = I.xyxy_to_bbox(F.array(F.col("l_partkey").cast("double"), F.lit(0.0), F.col("l_suppkey").cast("double"), F.lit(1.0)))
    return T(s, d, "lineitem").select(F.col("l_orderkey").alias("assessment_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("n"), b["x"].alias("x"), b["width"].alias("width"))


@query("s1_scan_file_manifest", "select doc_id, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) as extension, case when lower(regexp_extract(name, '(\\.[^./]*)$', 1)) not in ('.pdf', '.png', '.jpg', '.jpeg', '.docx') then 'unsupported_extension' when n_chars * 20000 > 52428800 then 'too_large' end as reason from (select doc_id, n_chars, concat('scan', doc_id, case doc_id % 4 when 0 then '.PDF' when 1 then '.jpeg' when 2 then '.exe' else '' end) as name from documents)")
def s1(s, d):
    rows = T(s, d, "documents").selectExpr("doc_id", "n_chars * 20000 as length", "concat('scan', doc_id, case doc_id % 4 when 0 then '.PDF' when 1 then '.jpeg' when 2 then '.exe' else '' end) as name")
    return rows.withColumn("v", I.file_verdict(F.col("name"), F.col("length"))).select("doc_id", "v.extension", "v.reason")


@query("s1_scan_files", "select coalesce(source, 'none') as source, (coalesce(doc_id, 0) % 3)::integer as part, '.txt' as extension, 'unsupported_extension' as reason, sum(coalesce(strlen(text), 0) + 1)::bigint as length from documents group by 1, 2")
def s1f(s, d):
    """Texts written as files, one for each source and part, and listed from where they lie."""
    path = f"{shared_folder(s)}/scans-{uuid.uuid4().hex}"
    docs = T(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), (F.coalesce("doc_id", F.lit(0)) % 3).cast("int").alias("part"), "text")
    docs.write.partitionBy("source", "part").text(path)
    files = I.scan_file_manifest(s, path)
    at = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    return files.groupBy(at("source").alias("source"), at("part").cast("int").alias("part"), "extension", "reason").agg(F.sum("length").alias("length"))


def responses(s, d):
    """Model answers of each conversation as JSON: fenced, truncated, broken or plain by its id."""
    rows = T(s, d, "questions").groupBy(F.col("assessment_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("order_index", "number", "text", F.col("max_marks").cast("string").alias("max_marks")))).alias("q"))
    items = F.to_json(F.struct(F.transform("q", lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"), x["max_marks"].alias("max_marks"), F.lit("mcq").alias("question_type"))).alias("questions"), F.array().cast("array<struct<number: string>>").alias("answers")))
    i = F.col("document_id").cast("long") % 5
    text = F.when(i == 0, F.concat(F.lit("```json\n"), items, F.lit("\n```"))).when(i == 1, F.concat(F.lit("Here it is: "), items, F.lit(" done"))).when(i == 2, F.substring(items, 1, F.length(items) - 4)).when(i == 3, F.lit("no answer")).otherwise(items)
    return rows.select("document_id", F.lit(1).alias("page"), text.alias("response_text"), F.lit("STOP").alias("finish_reason"))


@query("s3_read_model_responses", "select assessment_id::varchar as document_id, case assessment_id % 5 when 2 then 'bad' when 3 then 'bad' else 'ok' end as verdict from (select distinct assessment_id from questions)")
def s3(s, d):
    return I.read_model_responses(responses(s, d)).select("document_id", F.when(F.col("reason").isNull(), "ok").otherwise("bad").alias("verdict"))


@query("s4_explode_questions", f"select assessment_id::varchar as document_id, 'Q' || {NUM.format(c='number')} as id, 'MCQ' as question_type, case when max_marks = 0 then 2 else max_marks end::decimal(10,2) as max_marks, length(trim(text)) as n from questions where assessment_id % 5 not in (2, 3)")
def s4(s, d):
    return I.explode_questions(I.read_model_responses(responses(s, d))).select("document_id", "id", "question_type", "max_marks", F.length("text").cast("long").alias("n"))


@query("s4_explode_answers", f"""select * from (select assessment_id::varchar as document_id, 'ans_vlm_p1_' || (row_number() over (partition by assessment_id order by order_index, answer_id) - 1) as answer_id, {REF.format(c="question_number")} as question_number, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as text from answers)
  where text <> '' or question_number is not null""")
def s4a(s, d):
    packed = F.array_sort(F.collect_list(F.struct("order_index", "answer_id", "question_number", F.col("text").alias("answer_text"))))
    rows = T(s, d, "answers").groupBy(F.col("assessment_id").cast("string").alias("document_id")).agg(packed.alias("answers"))
    told = rows.select("document_id", F.lit(1).alias("page"), F.to_json(F.struct("answers")).alias("response_text"), F.lit("STOP").alias("finish_reason"))
    return I.explode_answers(I.read_model_responses(told)).select("document_id", "answer_id", "question_number", "text")


@query("j1_direct_match", f"select assessment_id, question_id, answer_id, text, n_answers, 'matched' as status from ({MATCH})")
def j1(s, d):
    return matched(s, d).select("assessment_id", "question_id", "answer_id", "text", F.col("n_answers").cast("long").alias("n_answers"), "status")


def matched(s, d):
    return MT.direct_match(T(s, d, "questions"), T(s, d, "answers"))


PROPOSED = "select assessment_id, id as question_id, order_index % 4 as ord, case when order_index % 6 = 0 then 'unanswered' else 'matched' end as status, case when order_index % 4 = 2 then 'ans_nope' else concat('ans_', order_index + 1) end as answer_id, 0.75 as confidence from {q}"


def proposals(s, d):
    return s.sql(PROPOSED.format(q="{q}"), q=T(s, d, "questions"))


@query("j2_apply_match_proposals", f"select p.assessment_id, p.question_id, case when p.status = 'matched' and a.answer_id is not null then 'matched' else 'unanswered' end as status, case when p.status = 'matched' and a.answer_id is not null then a.answer_id else 'empty_' || p.question_id end as answer_id from ({PROPOSED.format(q='questions')}) p left join answers a using (assessment_id, answer_id) where (p.assessment_id, p.question_id) not in (select (assessment_id, question_id) from ({MATCH}))")
def j2(s, d):
    q, a = T(s, d, "questions"), T(s, d, "answers")
    return MT.apply_match_proposals(q, matched(s, d), a, proposals(s, d)).select("assessment_id", "question_id", "status", "answer_id")


@query("j3_fill_unanswered", f"select q.assessment_id, q.id as question_id, case when m.answer_id is null then 'unanswered' else 'matched' end as status, coalesce(m.answer_id, 'empty_' || q.id) as answer_id from questions q left join ({MATCH}) m on q.assessment_id = m.assessment_id and q.id = m.question_id")
def j3(s, d):
    return MT.fill_unanswered(T(s, d, "questions"), matched(s, d)).select("assessment_id", "question_id", "status", "answer_id")


@query("j4_unmatched_answers", f"select assessment_id, answer_id from answers where (assessment_id, answer_id) not in (select (assessment_id, unnest(ids)) from ({MATCH}))")
def j4(s, d):
    used = matched(s, d).select("assessment_id", F.explode("answer_ids").alias("answer_id"))
    return MT.unmatched_answers(T(s, d, "answers"), used).select("assessment_id", "answer_id")


@query("j5_apply_answer_key", "select assessment_id, id, case when u and order_index % 4 = 0 then 'C' else correct_option end as correct_option, case when u and order_index % 4 = 0 then correct_answer when u then 'answer ' || order_index else correct_answer end as correct_answer from (select *, coalesce(trim(correct_answer), '') = '' and coalesce(trim(correct_option), '') = '' as u from questions)")
def j5(s, d):
    q = T(s, d, "questions")
    early = q.selectExpr("assessment_id", "1 as ord", "number", "'A' as correct_option", "'old' as correct_answer", "array('x') as key_points")
    late = q.selectExpr("assessment_id", "2 as ord", "id as number", "case when order_index % 4 = 0 then ' c ' else 'Z' end as correct_option", "case when order_index % 4 = 0 then ' ' else concat('answer ', order_index) end as correct_answer", "array(' k ', '') as key_points")
    late = late.withColumn("number", q_number(late))
    return MT.apply_answer_key(q, early.unionByName(late)).select("assessment_id", "id", "correct_option", "correct_answer")


def q_number(late):
    """The later solutions name questions with a part by it, as the paper does."""
    n = F.regexp_extract("number", r"(\d+)", 1).cast("int")
    return F.when(n % 5 == 4, F.concat(n, F.lit("(a)"))).otherwise(F.col("number"))


@query("j27_weighted_match_score", "select l_orderkey as assessment_id, l_partkey as part, l_suppkey as supp, l_linenumber as n, round_even((((case when anchored then 0.40 else 0.00 end) * a + (case when anchored then 0.30 else 0.55 end) * b + (case when anchored then 0.15 else 0.25 end) * c + (case when anchored then 0.10 else 0.15 end) * e + 0.05 * f) * case when conflict then 0.7 else 1.0 end)::decimal(12,5), 3)::decimal(10,3) as score from (select *, l_linenumber % 2 = 0 as anchored, l_tax > 0.06 as conflict, (l_partkey % 1000 / 1000.0)::decimal(6,3) a, (l_suppkey % 1000 / 1000.0)::decimal(6,3) b, 0.700::decimal(6,3) c, (l_linenumber / 10.0)::decimal(6,3) e, 0.500::decimal(6,3) f from lineitem)")
def j27(s, d):
    rows = T(s, d, "lineitem").selectExpr("*", "cast(l_partkey % 1000 / 1000.0 as decimal(6,3)) as a", "cast(l_suppkey % 1000 / 1000.0 as decimal(6,3)) as b", "cast(0.7 as decimal(6,3)) as c", "cast(l_linenumber / 10.0 as decimal(6,3)) as e", "cast(0.5 as decimal(6,3)) as f")
    score = MT.weighted_match_score(F.col("l_linenumber") % 2 == 0, dict(zip(("anchor", "semantic", "layout", "order", "type"), map(F.col, "abcef"), strict=True)), F.col("l_tax") > 0.06)
    return rows.select(F.col("l_orderkey").alias("assessment_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("n"), score.alias("score"))


LEXICAL = """
  with t as (select assessment_id as c, 'l' as side, id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from questions union all select assessment_id, 'r', answer_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) from answers),
  tf as (select c, side, id, term, count(*) tf from t group by all), df as (select c, term, count(*) df from tf group by all),
  n as (select c, count(*) n from (select assessment_id c, id from questions union all select assessment_id, answer_id from answers) group by 1),
  w as (select tf.*, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join df using (c, term) join n using (c)), u as (select c, side, id, term, w / sqrt(sum(w * w) over (partition by c, side, id)) u from w),
  sim as (select a.c, a.id as left_id, b.id as right_id, least(1.0, sum(a.u * b.u)) s from u a join u b on a.c = b.c and a.term = b.term and a.side = 'l' and b.side = 'r' group by all)"""


def lexical(s, d):
    q = T(s, d, "questions").select(F.col("assessment_id").alias("corpus_id"), "id", "text")
    a = T(s, d, "answers").select(F.col("assessment_id").alias("corpus_id"), F.col("answer_id").alias("id"), "text")
    return MT.lexical_similarity(q, a)


@query("j14_lexical_similarity", LEXICAL.strip() + " select c as corpus_id, left_id, right_id, round_even(s, 6) as similarity from sim")
def j14(s, d):
    return lexical(s, d).select("corpus_id", "left_id", "right_id", F.bround("similarity", 6).alias("similarity"))


@query("j14_lexical_best", LEXICAL.strip() + " select c as corpus_id, count(*) as pairs, round(sum(s), 4) as total from sim group by 1")
def j14b(s, d):
    return lexical(s, d).groupBy("corpus_id").agg(F.count("*").alias("pairs"), F.round(F.sum("similarity"), 4).alias("total"))


@query("j14_lexical_candidates", r"""
  with x as (select coalesce(lang, '') c, doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w from documents),
  t as (select c, 'l' as side, id, unnest(w) as term from x where id % 50 = 0 union all select c, 'r', id, unnest(w) from x),
  tf as (select c, side, id, term, count(*) tf from t group by all), df as (select c, term, count(*) df from tf group by all),
  n as (select c, count(*) + count(*) filter (id % 50 = 0) n from x group by 1),
  w as (select tf.*, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join df using (c, term) join n using (c)), u as (select c, side, id, term, w / sqrt(sum(w * w) over (partition by c, side, id)) u from w),
  sim as (select a.c, a.id as left_id, b.id as right_id, round_even(least(1.0, sum(a.u * b.u)), 4) s from u a join u b on a.c = b.c and a.term = b.term and a.side = 'l' and b.side = 'r' group by all)
  select c as corpus_id, left_id, right_id, s as similarity from (select *, row_number() over (partition by c, left_id order by s desc, right_id) r from sim) where r <= 5""")
def j14c(s, d):
    """Every 50th document against all of its language."""
    docs = T(s, d, "documents").select(F.coalesce("lang", F.lit("")).alias("corpus_id"), F.col("doc_id").alias("id"), "text")
    return MT.lexical_best(docs.where("id % 50 = 0"), docs)


def vectors(s, d):
    v = T(s, d, "embeddings").select(F.col("label").alias("corpus_id"), F.col("vec_id").alias("id"), "embedding")
    return v.where("id % 50 = 0"), v


@query("j15_dense_similarity", "select a.label as corpus_id, a.vec_id as left_id, b.vec_id as right_id, round(greatest(0, least(1, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))), 6) as similarity from embeddings a join embeddings b on a.label = b.label where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id")
def j15(s, d):
    left, right = vectors(s, d)
    return MT.dense_similarity(left, right, apart=True).select(F.col("corpus_id").cast("int").alias("corpus_id"), "left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query("j16_semantic_candidates", "select corpus_id, left_id, right_id, rank::integer as rank from (select a.label as corpus_id, a.vec_id as left_id, b.vec_id as right_id, row_number() over (partition by a.label, a.vec_id order by round(greatest(0, least(1, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))), 4) desc, b.vec_id) rank from embeddings a join embeddings b on a.label = b.label where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) where rank <= 5")
def j16(s, d):
    left, right = vectors(s, d)
    best = MT.dense_similarity(left, right, k=5, apart=True, decimals=4)
    return MT.semantic_candidates(best).select(F.col("corpus_id").cast("int").alias("corpus_id"), "left_id", "right_id", "rank")


@query("j16_candidate_states", LEXICAL.strip() + """, r as (select c, left_id, right_id, round_even(s, 4) s, row_number() over (partition by c, left_id order by round_even(s, 4) desc, right_id) rank from sim),
  b as (select *, max(s) filter (rank = 1) over (partition by c, left_id) best, coalesce(max(s) filter (rank = 2) over (partition by c, left_id), 0) runner_up from r),
  m as (select *, round_even(best - runner_up, 4) margin from b)
  select c as corpus_id, left_id, right_id, rank::integer as rank, s as similarity, margin, case when best >= 0.60 and margin >= 0.05 then 'clear' when best >= 0.35 and margin < 0.05 then 'ambiguous' when best < 0.35 then 'low_similarity' else 'moderate' end as state from m where rank <= 5""")
def j16s(s, d):
    return MT.semantic_candidates(lexical(s, d)).select("corpus_id", "left_id", "right_id", "rank", "similarity", "margin", "state")


@query("w1_natural_question_order", f"select assessment_id, id, (row_number() over (partition by assessment_id order by order_index // 3, coalesce(try_cast(regexp_extract({NUM.format(c='number')}, '^\\s*(\\d{{1,3}})', 1) as integer), 999), case when regexp_matches(number, '\\(a\\)') then 97 else -1 end, order_index) - 1)::integer as question_index from questions")
def w1(s, d):
    q = T(s, d, "questions").withColumns({"page": F.floor(F.col("order_index") / 3), "number": I.clean_question_number(F.col("number"), F.lit(0))})
    return MT.natural_question_order(q).select("assessment_id", "id", "question_index")


@query("w6_global_answer_order", "select assessment_id, answer_id, (row_number() over (partition by assessment_id order by order_index // 4, order_index) - 1)::integer as sequence from answers")
def w6(s, d):
    return MT.global_answer_order(T(s, d, "answers").withColumn("page", F.floor(F.col("order_index") / 4))).select("assessment_id", "answer_id", "sequence")


@query("u1_union_pages", "select order_index % 3 as page, count(*) as n from questions where order_index % 3 <> 1 group by 1")
def u1(s, d):
    q = T(s, d, "questions").withColumn("page", F.col("order_index") % 3)
    return MT.union_pages(q.where("page = 0"), None, q.where("page = 2").drop("section")).groupBy("page").agg(F.count("*").alias("n"))


@query("u5_distinct_texts", "select count(*) as texts, count(distinct text) - count(distinct text) filter (source = 'src1') as missing, count(*) filter (text in (select text from documents where source = 'src1')) as hits from documents")
def u5(s, d):
    docs = T(s, d, "documents")
    known = docs.where("source = 'src1'").select(F.sha2(F.concat(F.lit("m:"), "text").cast("binary"), 256).alias("key")).distinct()
    hits, missing = MT.distinct_texts(docs.select("doc_id", "text"), known, "m")
    told = hits.select(F.lit("text").alias("what"), "hit").union(missing.select(F.lit("missing"), F.lit(False)))
    n = lambda c: F.count_if(c).alias
    return told.agg(n(F.col("what") == "text")("texts"), n(F.col("what") == "missing")("missing"), n(F.col("hit"))("hits"))


@query("s2_read_blocks", "select assessment_id::varchar as document_id, count(*) as n from questions group by 1")
def s2(s, d):
    """Blocks written as JSON lines and read with the fixed schema."""


    path = f"{shared_folder(s)}/blocks-{uuid.uuid4().hex}"
    T(s, d, "questions").selectExpr("cast(assessment_id as string) as document_id", "id", "text", "1D as confidence", "1 as page").write.json(path)
    return I.read_blocks(s, path).where("_corrupt_record is null").groupBy("document_id").agg(F.count("*").alias("n"))


@query("s5_write_read_results", "select l_returnflag as ingest_date, count(*) as n, sum(l_quantity)::decimal(18,2) as marks from lineitem group by 1")
def s5(s, d):


    path = f"{shared_folder(s)}/results-{uuid.uuid4().hex}"
    rows = T(s, d, "lineitem").selectExpr("l_returnflag as ingest_date", "l_orderkey as assessment_id", "l_quantity")
    I.write_results(rows.where("ingest_date <> 'A'"), path)
    I.write_results(rows.where("ingest_date = 'A'"), path)
    return I.read_results(s, path).groupBy("ingest_date").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("decimal(18,2)").alias("marks"))


