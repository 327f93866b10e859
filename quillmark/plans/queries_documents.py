"""Queries over document regions and structure graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import graph as GR
from quillmark.operators import regions as RG
from quillmark.plans.entries import BODIES, joined, query
from quillmark.plans.fixtures import CONTESTED_DUCKDB, HALVES_DUCKDB, contested, halves, regions, table
from quillmark.plans.fixtures import REGIONS_DUCKDB as R

ROW = "page, y, x, region_id"


def edges(s, d):
    """Options, parts and continuations of the question before them in their document, and some wrong edges."""
    r = regions(s, d).where("ord % 7 > 0 and ord % 7 < 6")
    rel = F.when(F.col("ord") % 7 <= 3, "option_of").when(F.col("ord") % 7 == 4, "subquestion_of").otherwise("continuation_of")
    target = F.concat("document_id", F.lit("_"), F.col("ord") - F.col("ord") % 7)
    good = r.select("document_id", F.col("region_id").alias("source_id"), target.alias("target_id"), rel.alias("relationship"), F.lit(0.9).alias("confidence"))
    loops = regions(s, d).where("ord % 11 = 3").select("document_id", F.col("region_id").alias("source_id"), F.col("region_id").alias("target_id"), F.lit("follows").alias("relationship"), F.lit(0.5).alias("confidence"))
    lost = regions(s, d).where("ord % 13 = 5").select("document_id", F.col("region_id").alias("source_id"), F.lit("nowhere").alias("target_id"), F.lit("belongs_to").alias("relationship"), F.lit(0.7).alias("confidence"))
    return good.union(loops).union(lost)


EDGES = f"""edges as (select document_id, region_id as source_id, document_id || '_' || (ord - ord % 7) as target_id, case when ord % 7 <= 3 then 'option_of' when ord % 7 = 4 then 'subquestion_of' else 'continuation_of' end as relationship, 0.9::double as confidence from regions where ord % 7 between 1 and 5
  union all select document_id, region_id, region_id, 'follows', 0.5::double from regions where ord % 11 = 3 union all select document_id, region_id, 'nowhere', 'belongs_to', 0.7::double from regions where ord % 13 = 5)"""
G = f"{R}, {EDGES}"
RECURSIVE = R.replace("with ", "with recursive ", 1)

# how regions fit boxes of a table named boxes: the parts that add up to a score
FITS = """fits as (select * exclude (ox, oy, area, region_area, tallest, widest, inside, held), case when held then 0.70 when inside then 0.50 else 0 end
    + least(0.50, ox * oy / area * 2.25) + least(0.40, ox * oy / region_area * 1.4) + least(0.35, oy / tallest * 1.25) + least(0.25, ox / widest) as score
  from (select b.document_id, b.page, b.box_id, r.region_id, r.text, r.x, r.y, greatest(0, least(b.x + b.width, r.x + r.width) - greatest(b.x, r.x)) ox, greatest(0, least(b.y + b.height, r.y + r.height) - greatest(b.y, r.y)) oy,
      greatest(1, b.width * b.height) area, greatest(1, r.width * r.height) region_area, greatest(1, b.height, r.height) tallest, greatest(1, b.width, r.width) widest,
      r.x + r.width / 2 between b.x - 15 and b.x + b.width + 15 and r.y + r.height / 2 between b.y - 15 and b.y + b.height + 15 inside,
      r.x >= b.x - 5 and r.y >= b.y - 5 and r.x + r.width <= b.x + b.width + 5 and r.y + r.height <= b.y + b.height + 5 held
    from boxes b join regions r on b.document_id = r.document_id and b.page = r.page) where (ox * oy > 0 or inside) and score >= 0.15)"""


@query("p12_normalize_whitespace", "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as digest from documents")
def p12(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(RG.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query("p13_is_garbled", f"{R} select region_id, trim(text, E' \\t\\n\\r') = '' or (n >= 6 and (n / greatest(length(trim(text, E' \\t\\n\\r')), 1) < 0.4 or not regexp_matches(letters, '[aeiouAEIOU]'))) as garbled from (select *, length(letters) n from (select *, regexp_replace(text, '[^\\p{{L}}]', '', 'g') letters from regions))")
def p13(s, d):
    return regions(s, d).select("region_id", RG.is_garbled(F.col("text")).alias("garbled"))


JACCARD = "case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end"


@query("p14_token_jaccard", f"{R} select region_id, round({JACCARD}, 6) as similarity from (select region_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(next_text), '[a-z0-9]+')) b from (select *, coalesce(lead(text) over (partition by document_id order by ord), '') as next_text from regions))")
def p14(s, d):
    return pairs(s, d).select("region_id", F.round(RG.token_jaccard(F.col("text"), F.col("next_text")), 6).alias("similarity"))


def pairs(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("ord")
    return regions(s, d).withColumn("next_text", F.coalesce(F.lead("text").over(w), F.lit("")))


GARBLED = r"({0} = '' or (length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= 6 and (length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) / greatest(length({0}), 1) < 0.4 or not regexp_matches(regexp_replace({0}, '[^\p{{L}}]', '', 'g'), '[aeiouAEIOU]'))))"


@query("p15_choose_text_source", f"""{R} select region_id, case when source = 'OCR' then o else m end as text, source
  from (select *, case when m = '' then 'OCR' when o = '' then 'VLM_FALLBACK_EMPTY_OCR' when {GARBLED.format("o")} and not {GARBLED.format("m")} then 'VLM_FALLBACK_GARBLED_OCR' when {JACCARD} < 0.25 and length(m) >= 3 then 'VLM_OVERRIDE_LOW_AGREEMENT' else 'OCR' end as source
    from (select *, list_distinct(regexp_extract_all(lower(o), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(m), '[a-z0-9]+')) b
      from (select region_id, trim(text, E' \\t\\n\\r') as o, trim(coalesce(lead(text) over (partition by document_id order by ord), ''), E' \\t\\n\\r') as m from regions)))""")  # fmt: skip
def p15(s, d):
    return pairs(s, d).withColumn("c", RG.choose_text_source(F.col("text"), F.col("next_text"))).select("region_id", "c.text", "c.source")


def hypotheses(s, d):
    return regions(s, d).withColumn("hypotheses", RG.classify_region(F.col("text"), F.col("y"), F.col("height"), F.lit(1000.0)))


#: What the text, the place and header terms say of each region, in this order.
SAID = rf"""
  (select region_id, unnest(list_filter([parser, case when coalesce(parser.type not in ('QUESTION', 'SUBQUESTION', 'OPTION'), true) then layout end, meta], lambda x: x is not null)) as h, generate_subscripts(list_filter([parser, case when coalesce(parser.type not in ('QUESTION', 'SUBQUESTION', 'OPTION'), true) then layout end, meta], lambda x: x is not null), 1) as i
    from (select region_id, case when regexp_matches(t, '{RG.INSTRUCTION}') then {{type: 'INSTRUCTION', confidence: 0.90::double, source: 'parser'}} when regexp_matches(t, '{RG.SECTION}') then {{type: 'SECTION_HEADER', confidence: 0.95::double, source: 'parser'}}
          when regexp_matches(t, '{RG.NUMBERED}') then {{type: 'QUESTION', confidence: case when regexp_matches(t, '{RG.ASKING}') then 0.92 else 0.80 end::double, source: 'parser'}} when regexp_matches(t, '{RG.PART}') or regexp_matches(t, '{RG.ROMAN_PART}') then {{type: 'SUBQUESTION', confidence: 0.82::double, source: 'parser'}}
          when regexp_matches(t, '{RG.OPTION}') then {{type: 'OPTION', confidence: 0.88::double, source: 'parser'}} end as parser,
        case when regexp_matches(t, '{RG.FIGURE}') then {{type: 'DIAGRAM', confidence: 0.90::double, source: 'layout_analyzer'}} when regexp_matches(t, '(?m)^\|.*?\|') or regexp_matches(t, '(?i)\bTable\s*\d*[:.\s]') or length(t) - length(replace(t, chr(9), '')) >= 2 then {{type: 'TABLE', confidence: 0.88::double, source: 'layout_analyzer'}}
          when y / 1000 < 0.06 and not regexp_matches(t, '[.?!]$') and not regexp_matches(t, '{RG.PREFIXED}') then {{type: 'HEADER', confidence: 0.85::double, source: 'layout_analyzer'}} when (y + height) / 1000 > 0.94 then {{type: 'FOOTER', confidence: 0.85::double, source: 'layout_analyzer'}} end as layout,
        case when regexp_matches(t, '{RG.METADATA}') then {{type: 'METADATA', confidence: 0.90::double, source: 'semantic_analyzer'}} end as meta
      from (select *, trim(text, E' \t\n\r') as t from regions)))"""


@query("p16_classify_region", f"{R} select region_id, h.type as type, h.confidence as confidence, h.source as source from {SAID}")
def p16(s, d):
    # outer: for a plain explode Spark filters by the list's size first, which classifies each region twice
    return hypotheses(s, d).select("region_id", F.explode_outer("hypotheses").alias("h")).where("h is not null").select("region_id", "h.type", "h.confidence", "h.source")


@query("p17_resolve_hypotheses", f"""{R}
  select r.region_id, coalesce(top, 'UNKNOWN') as type, round(coalesce(case when types > 1 then best * 0.85 else best end, 0.5), 6)::double as confidence, coalesce(types > 1, false) as conflict
  from regions r left join (select region_id, arg_min(h.type, {{a: -h.confidence, b: i}}) as top, max(h.confidence) as best, count(distinct h.type) as types from {SAID} group by 1) using (region_id)""")  # fmt: skip
def p17(s, d):
    return hypotheses(s, d).withColumn("r", RG.resolve_hypotheses(F.col("hypotheses"))).select("region_id", "r.type", F.bround("r.confidence", 6).alias("confidence"), "r.conflict")


@query("p18_fragment_and_parent", f"{R} select region_id, (regexp_matches(text, '{RG.MARKER}') and length(trim(text)) <= 8) or regexp_matches(text, '{RG.BARE}') as fragment, text like '%:' as group_parent from regions where role = 'QUESTION'")
def p18(s, d):
    return regions(s, d).where("role = 'QUESTION'").select("region_id", RG.is_fragment(F.col("text")).alias("fragment"), RG.is_group_parent(F.col("text")).alias("group_parent"))


@query("p11_display_number", f"{R} select region_id, case when ord <= 999 then ord::varchar else '1' end as number from regions where role = 'QUESTION'")
def p11(s, d):
    return regions(s, d).where("role = 'QUESTION'").select("region_id", RG.display_number(F.col("text")).alias("number"))


@query("p31_answer_anchor", f"{R} select region_id, 'Q' || regexp_extract(text, '^(\\d{{1,3}})', 1) as anchor from regions where role = 'QUESTION'")
def p31(s, d):
    return regions(s, d).where("role = 'QUESTION'").select("region_id", RG.answer_anchor(F.col("text")).alias("anchor"))


@query("p28_union_bbox", f"{R} select document_id, page, round_even(min(x), 1) as x, round_even(min(y), 1) as y, round_even(max(x + width) - min(x), 1) as width, round_even(max(y + height) - min(y), 1) as height from regions group by 1, 2")
def p28(s, d):
    return RG.union_bbox(regions(s, d), "document_id", "page")


@query("f3_vocabulary_check", "select event_id, case event_type when 'view' then 'QUESTION' when 'click' then 'INSTRUCTION' else 'UNKNOWN' end as role, case event_type when 'view' then 'option_of' when 'click' then 'follows' else 'belongs_to' end as relation from events")
def f3(s, d):
    e = table(s, d, "events")
    role = F.when(F.col("event_type") == "view", " question").when(F.col("event_type") == "click", "Administrative").when(F.col("event_type") == "error", "CONTINUATION").otherwise(F.col("event_type"))
    rel = F.when(F.col("event_type") == "view", "OPTION_OF").when(F.col("event_type") == "click", "follows").otherwise("near")
    r, x = GR.vocabulary_check(role, rel)
    return e.select("event_id", r.alias("role"), x.alias("relation"))


def conflicted(s, d):
    return hypotheses(s, d).withColumn("r", RG.resolve_hypotheses(F.col("hypotheses"))).select("document_id", "region_id", "hypotheses", F.col("r.confidence").alias("confidence"), F.col("r.conflict").alias("classification_conflict"))


@query("f5_verification_targets", f"{R} select document_id, region_id from regions where confidence < 0.80 or ord % 5 = 0")
def f5(s, d):
    return RG.verification_targets(regions(s, d).withColumn("classification_conflict", F.col("ord") % 5 == 0)).select("document_id", "region_id")


@query("f5_targets_skipped", f"{R} select document_id, count(*) as regions, count(*) filter (confidence < 0.80 or ord % 5 = 0) as sent, count(*) filter (not (confidence < 0.80 or ord % 5 = 0)) as skipped from regions group by 1")
def f5s(s, d):
    return RG.targets_skipped(regions(s, d).withColumn("classification_conflict", F.col("ord") % 5 == 0))


@query("a24_region_conflicts", f"{R} select r.document_id, region_id, array_to_string(list_sort(list(h.source || ':' || h.type)), ' | ') as competing from {SAID} join regions r using (region_id) group by 1, 2 having count(distinct h.type) > 1")
def a24(s, d):
    return joined(RG.region_conflicts(conflicted(s, d)), "competing")


@query("w2_reading_order", f"{R} select document_id, page, region_id as source_id, prev as target_id, 'follows' as relationship, 0.95::double as confidence from (select *, lag(region_id) over (partition by document_id, page order by y, x, region_id) prev from regions) where prev is not null")
def w2(s, d):
    return RG.reading_order(regions(s, d))


@query("w3_reading_columns", f"{R} select region_id, col::integer as column, (row_number() over (partition by document_id, page order by col, y, x, region_id))::integer as order_in_page from (select *, case when two and x + width / 2 >= 500 then 1 else 0 end col from (select *, count(*) filter (width < 600 and x + width / 2 < 500) over p >= 2 and count(*) filter (width < 600 and x + width / 2 >= 500) over p >= 2 as two from regions window p as (partition by document_id, page)))")
def w3(s, d):
    return RG.reading_columns(regions(s, d), F.lit(1000.0)).select("region_id", "column", "order_in_page")


@query("w4_dedupe_by_number", f"{R} select document_id, region_id from (select *, case when ord % 4 = 3 then null else (ord % 6)::varchar end number from regions) qualify number is null or row_number() over (partition by document_id, number order by confidence desc, {ROW}) = 1")
def w4(s, d):
    r = regions(s, d).withColumn("number", F.when(F.col("ord") % 4 != 3, (F.col("ord") % 6).cast("string")))
    return RG.dedupe_by_number(r).select("document_id", "region_id")


@query("w5_dedupe_by_position", f"{R} select document_id, region_id from (select *, floor(y / 3) as z from regions) qualify row_number() over (partition by document_id, page, round_even(z / 5, 0) order by z, x, region_id) = 1")
def w5(s, d):
    return RG.dedupe_by_position(regions(s, d).withColumn("y", F.floor(F.col("y") / 3).cast("double"))).select("document_id", "region_id")


@query("w9_page_neighbour_context", f"{R}, t as (select document_id, page, array_to_string((list(text order by y, x, region_id))[:5], ' | ')[:200] as summary from regions group by 1, 2) select t.document_id, t.page, a.summary as prev_page_summary, b.summary as next_page_summary from t left join t a on t.document_id = a.document_id and t.page = a.page + 1 left join t b on t.document_id = b.document_id and t.page = b.page - 1")
def w9(s, d):
    return RG.page_neighbour_context(regions(s, d))


@query("w10_page_cap", f"{R} select document_id, count(*) as n from regions where page <= 2 group by 1")
def w10(s, d):
    return RG.page_cap(regions(s, d), 2).groupBy("document_id").agg(F.count("*").alias("n"))


@query("w10_page_groups", f"{R} select region_id, floor((page - 1) / ceil(max(page) over (partition by document_id) / 2))::bigint as page_group from regions")
def w10g(s, d):
    return RG.page_groups(regions(s, d), 2).select("region_id", "page_group")


def boxes(s, d):
    """A visual box round every question and what follows it."""
    return regions(s, d).where("role = 'QUESTION'").select("document_id", "page", F.col("region_id").alias("box_id"), (F.col("x") - 3).alias("x"), (F.col("y") - 3).alias("y"), (F.col("width") + 6).alias("width"), F.lit(86.0).alias("height"))


@query("j6_ground_boxes", f"""{R}, boxes as (select document_id, page, region_id as box_id, x - 3 as x, y - 3 as y, width + 6 as width, 86 as height from regions where role = 'QUESTION'), {FITS},
  kept as (select document_id, box_id, string_agg(region_id, ' | ' order by y, x, region_id) as ids, count(*) n, max(top) top from (select *, max(score) over (partition by document_id, page, box_id) top from fits) where score >= greatest(0.2, top * 0.5) group by 1, 2)
  select document_id, box_id, coalesce(ids, '') as region_ids, case when n is null then 'UNGROUNDED' when (n = 1 and top < 0.30) or (n > 1 and top < 0.40) then 'PARTIALLY_GROUNDED' else 'GROUNDED' end as status
  from boxes left join kept using (document_id, box_id)""")
def j6(s, d):
    return joined(RG.ground_boxes(boxes(s, d), regions(s, d)).select("document_id", "box_id", "region_ids", "status"), "region_ids")


@query("j9_nearest_preceding_parent", f"{R} select document_id, page, region_id as source_id, q as target_id, 'option_of' as relationship, 0.9::double as confidence from (select *, last_value(case when role = 'QUESTION' then region_id end ignore nulls) over (partition by document_id, page order by y, x, region_id rows between unbounded preceding and 1 preceding) q from regions) where role = 'OPTION' and q is not null")
def j9(s, d):
    return RG.nearest_preceding_parent(regions(s, d).withColumnRenamed("role", "region_type"))


@query("j10_same_row_body", f"{R}, o as (select * from regions where role = 'OPTION' and ord % 7 = 2) select o.document_id, o.page, o.region_id as option_id, string_agg(b.text, ' ' order by b.x, b.region_id) as body from o join regions b on o.document_id = b.document_id and o.page = b.page and b.y + 0 = o.y + 50 and b.role not in ('QUESTION', 'OPTION', 'SECTION_HEADER', 'HEADER', 'FOOTER') where false group by 1, 2, 3 union all select o.document_id, o.page, o.region_id, trim(b.text, E' \\t\\r') from o join regions b on b.document_id = o.document_id and b.ord = o.ord where trim(b.text, E' \\t\\r') <> ''")
def j10(s, d):
    r = regions(s, d).withColumnRenamed("role", "region_type")
    bare = r.where("region_type = 'OPTION' and ord % 7 = 2").withColumns({"text": F.lit("(B)"), "x": F.lit(10.0), "width": F.lit(20.0)})
    body = r.where("region_type = 'OPTION' and ord % 7 = 2").withColumns({"region_type": F.lit("UNKNOWN"), "region_id": F.concat("region_id", F.lit("b")), "x": F.lit(60.0), "y": F.col("y") + 4})
    return RG.same_row_body(bare.unionByName(body))


@query("j17_section_membership", f"{R} select document_id, page, sec as source_id, region_id as target_id, 'section_member' as relationship, 0.95::double as confidence from (select *, last_value(case when role = 'SECTION_HEADER' then region_id end ignore nulls) over (partition by document_id, page order by y, x, region_id rows between unbounded preceding and 1 preceding) sec from regions) where role <> 'SECTION_HEADER' and sec is not null")
def j17(s, d):
    return RG.section_membership(regions(s, d).withColumnRenamed("role", "region_type"))


@query("j18_cross_page_continuation", rf"""{R}, p as (select document_id, page, arg_min(struct_pack(region_id, text, role), ord) as first, arg_max(struct_pack(region_id, text), ord) as last, arg_max(struct_pack(region_id, text), ord) filter (role = 'QUESTION') as question from regions group by 1, 2),
  n as (select document_id, coalesce(question, last) as b, lead(first) over (partition by document_id order by page) as a from p)
  select document_id, a.region_id as source_id, b.region_id as target_id, 'continuation_of' as relationship, 0.85::double as confidence from n where a is not null and a.role = 'UNKNOWN' and trim(b.text, E' \t\n\r') <> ''
    and (not regexp_matches(trim(b.text, E' \t\n\r'), '[.?!:;]$') or not regexp_matches(trim(a.text, E' \t\n\r'), '^\s*(SECTION|PART|Q\d+|\d+\.)', 'i'))""")
def j18(s, d):
    return RG.cross_page_continuation(regions(s, d).withColumnRenamed("role", "region_type"))


@query("f7_edge_spatial_validity", f"{G} select e.* from edges e left join regions a on e.source_id = a.region_id left join regions b on e.target_id = b.region_id where relationship not in ('option_of', 'subquestion_of') or (b.role = 'QUESTION' and b.y <= a.y + 25)")
def f7(s, d):
    return GR.edge_spatial_validity(edges(s, d), regions(s, d)).select("document_id", "source_id", "target_id", "relationship", "confidence")


@query("f8_edge_consistency", f"{G} select e.document_id, source_id, target_id, relationship, case when a.region_id is null or b.region_id is null then 'unknown_region' when source_id = target_id then 'self_link' end as reason from edges e left join regions a on e.source_id = a.region_id left join regions b on e.target_id = b.region_id")
def f8(s, d):
    return GR.edge_consistency(edges(s, d), regions(s, d)).select("document_id", "source_id", "target_id", "relationship", "reason")


@query("f9_prune_stale_continuations", f"{G} select document_id, source_id, target_id, relationship from edges where relationship <> 'continuation_of' or confidence > 2")
def f9(s, d):
    return GR.prune_stale_continuations(edges(s, d).withColumn("evidence_sources", F.array(F.lit("spatial_position"))), regions(s, d)).select("document_id", "source_id", "target_id", "relationship")


PAGES = "case page % 5 when 0 then 'COMPLETE' when 1 then 'AMBIGUOUS' when 2 then 'PARTIAL' when 3 then 'FAILED' else '' end"


@query("f10_demote_unclaimed", f"{R} select region_id, case when free and c = 'COMPLETE' then 'UNKNOWN' else role end as role, round(least(confidence, case when not h then 1.0 when free and c = 'COMPLETE' then 0.40 when free and c in ('AMBIGUOUS', 'PARTIAL') then 0.55 when c = 'FAILED' then 0.50 else 1.0 end), 6) as confidence, case when not h then state when free and c = 'COMPLETE' then 'UNVERIFIED' when (free and c in ('AMBIGUOUS', 'PARTIAL')) or c = 'FAILED' then 'UNCERTAIN' else state end as state from (select *, h and ord % 3 <> 0 as free from (select *, role in ('QUESTION', 'OPTION', 'SUBQUESTION') h, {PAGES} c from regions))")
def f10(s, d):
    r = regions(s, d)
    pages = r.select("document_id", "page").distinct().withColumn("completeness", F.expr(PAGES))
    return GR.demote_unclaimed(r, pages, r.where("ord % 3 = 0").select("document_id", "region_id")).select("region_id", "role", F.round("confidence", 6).alias("confidence"), "state")


def structures(s, d):
    """A model's structure for every question with its continuation, and for its options."""
    r = regions(s, d).where("ord % 7 in (0, 1, 2, 3)")
    ids = F.when(F.col("ord") % 7 == 0, F.array("region_id", F.concat("document_id", F.lit("_"), F.col("ord") + 5))).otherwise(F.array("region_id"))
    return r.select("document_id", "page", "ord", ids.alias("region_ids"), "role", F.when(F.col("ord") % 7 == 0, F.col("ord").cast("string")).alias("display_number"), "x", "y", "width", "height", "confidence")


# structure by structure: what is taken so far, and what the next one gets of it
CLAIMS = f"""{RECURSIVE}, boxes as (select document_id, page, ord as box_id, x, y, width, height from ({CONTESTED_DUCKDB}) where height is not null), {FITS},
  named as (select n.*, r.y as y0 from (select document_id, page, ord, unnest(region_ids) id, unnest(range(len(region_ids))) place from ({CONTESTED_DUCKDB})) n left join regions r on r.document_id = n.document_id and r.region_id = n.id),
  ids as (select document_id, page, ord, list({{'id': id, 'y': y0}} order by place) ids from named group by all),
  heads as (select document_id, page, list(id) heads from named where place = 0 group by all),
  fit as (select document_id, page, box_id as ord, list({{'id': region_id, 'score': score}} order by y, x, region_id) fit from fits group by all),
  s as (select *, row_number() over (partition by document_id, page order by ord) n from ({CONTESTED_DUCKDB}) left join ids using (document_id, page, ord) left join fit using (document_id, page, ord) left join heads using (document_id, page)),
  f as (
    select distinct document_id, page, 0::bigint n, []::varchar[] taken, null::integer ord, []::varchar[] got, false visual from s
    union all
    select document_id, page, n, list_concat(taken, list_filter(got, lambda c: not by_id or list_contains(list_transform(list_filter(ids, lambda i: i.y is not null), lambda i: i.id), c))), ord, got, not by_id and height is not null and len(got) = 0
    from (select *, case when by_id then list_concat([ids[1].id], list_transform(list_filter(ids[2:], lambda c: not list_contains(taken, c.id) and not list_contains(heads, c.id) and coalesce(abs(c.y - coalesce(ids[1].y, y, 0)) <= case when height is null then 200 else greatest(height, 150) end, true)), lambda c: c.id))
            else list_transform(list_filter(free, lambda c: c.score >= greatest(0.2, 0.5 * list_max(list_transform(free, lambda u: u.score)))), lambda c: c.id) end got
      from (select s.*, f.taken, coalesce(not list_contains(f.taken, s.ids[1].id), false) by_id, list_filter(coalesce(s.fit, []), lambda c: not list_contains(f.taken, c.id)) free
        from f join s on s.document_id = f.document_id and s.page = f.page and s.n = f.n + 1))),
  claims as (select document_id, page, ord, unnest(got) as region_id, case when unnest(range(len(got))) = 0 then 'head' else 'continuation' end as claim, got[1] as head_id from f
    union all select document_id, page, ord, 'visual_' || page || '_' || ord, 'visual', 'visual_' || page || '_' || ord from f where visual)"""


@query("j7_claim_regions", f"{CLAIMS} select document_id, page, ord, region_id, claim, head_id from claims")
def j7(s, d):
    return GR.claim_regions(contested(s, d), regions(s, d)).select("document_id", "page", "ord", "region_id", "claim", "head_id")


@query("j8_apply_model_roles", f"""{CLAIMS} select region_id, case when sure then c.role when claim = 'continuation' then 'UNKNOWN' else r.role end as role, round(case when sure then c.confidence else r.confidence end, 6) as confidence,
  case when sure or claim = 'continuation' then 'VERIFIED' when claim = 'head' then 'UNCERTAIN' else state end as state, case when claim = 'continuation' then head_id else parent_region_id end as parent_region_id
  from (select r.*, c.claim, c.head_id, struct_pack(role := t.role, confidence := t.confidence) c, coalesce(claim = 'head' and t.confidence >= 0.60 and t.role <> 'UNKNOWN', false) sure
    from regions r left join claims c on c.document_id = r.document_id and c.region_id = r.region_id left join ({CONTESTED_DUCKDB}) t on t.document_id = c.document_id and t.page = c.page and t.ord = c.ord) r""")
def j8(s, d):
    r, found = regions(s, d), contested(s, d)
    return GR.apply_model_roles(r, GR.claim_regions(found, r), found).select("region_id", "role", F.round("confidence", 6).alias("confidence"), "state", "parent_region_id")


def fused(s, d):
    h = p16(s, d).join(regions(s, d).select("document_id", "region_id"), "region_id")
    model = regions(s, d).where("ord % 3 = 0").select("region_id", F.col("role").alias("type"), F.lit(0.9).alias("confidence"), F.lit("vlm").alias("source"), "document_id")
    return GR.fuse_region_hypotheses(regions(s, d).withColumnRenamed("role", "region_type"), h.unionByName(model))


FUSED = f"""
  (with h as (select document_id, r.region_id, type, h.confidence, source from ({BODIES["p16_classify_region"]}) h join ({R} select * from regions) r on r.region_id = h.region_id union all select document_id, region_id, role, 0.9, 'vlm' from ({R} select * from regions) where ord % 3 = 0),
    t as (select document_id, region_id, type, sum(confidence * w) / sum(w) as score, max(confidence) filter (source = 'vlm') as vlm from (select *, case source when 'parser' then 0.85 when 'layout_analyzer' then 0.80 when 'semantic_analyzer' then 0.75 when 'vlm' then 0.90 else 0.70 end as w from h) group by 1, 2, 3),
    s as (select document_id, region_id, list(struct_pack(type, score, vlm) order by score desc, type) as s, max(vlm) as vlm from t group by 1, 2),
    x as (select r.document_id, r.region_id, r.role, r.confidence, s[1] as top, s.vlm is not null as given, s.vlm, s.s is null as bare, coalesce(s[1].score >= 0.70 and s[2].score >= 0.70, false) as conflict from ({R} select * from regions) r left join s on s.document_id = r.document_id and s.region_id = r.region_id),
    y as (select *, given and top.vlm is not null and top.score >= 0.75 and not conflict as agreed, round_even(least(1.0, 0.4 * confidence + 0.6 * top.score * case when conflict then 0.85 else 1.0 end), 4) as base from x)
  select document_id, region_id, coalesce(top.type, role) as region_type, case when bare then confidence when agreed then round_even(least(1.0, greatest(base, vlm) + 0.05), 4) else base end as confidence,
    case when bare then 'UNVERIFIED' when conflict then 'CONFLICTED' when agreed then 'VERIFIED' when given then case when top.score >= 0.80 then 'VERIFIED' else 'UNCERTAIN' end when top.score >= 0.85 then 'VERIFIED' when top.score < 0.60 then 'UNCERTAIN' else 'UNVERIFIED' end as verification_state, conflict as classification_conflict from y)"""


@query("j13_fuse_region_hypotheses", f"select region_id, region_type, round_even(confidence, 4) as confidence, verification_state, classification_conflict from {FUSED}")
def j13(s, d):
    return fused(s, d).select("region_id", "region_type", F.bround("confidence", 4).alias("confidence"), "verification_state", "classification_conflict")


@query("a23_verification_summary", f"select document_id, count(*) as total_regions, {', '.join(f'count(*) filter (verification_state = {s!r}) as {s.lower()}_count' for s in ('VERIFIED', 'CONFLICTED', 'UNCERTAIN', 'UNVERIFIED'))} from {FUSED} group by 1")
def a23(s, d):
    return GR.verification_summary(fused(s, d))


# pair by pair of top and bottom structures: the top one as it has grown, and which bottom ones are merged
STITCHED = f"""{RECURSIVE}, h as ({HALVES_DUCKDB}),
  t as (select *, row_number() over (partition by document_id, page order by ord) - 1 i from h where y < mid_y), b as (select *, row_number() over (partition by document_id, page order by ord) - 1 i, count(*) over (partition by document_id, page) nb from h where y >= mid_y),
  kids as (select document_id, page, list(id) kids from (select document_id, page, unnest(region_ids) id from b where role in ('OPTION', 'SUBQUESTION')) group by all),
  p as (select t.document_id, t.page, t.i * b.nb + b.i k, t.i ti, b.i bi, b.nb, t.ord tord, b.ord bord, t.role, b.role brole, t.region_ids tids, b.region_ids bids, t.display_number tnum, b.display_number bnum, t.confidence tc, b.confidence bc,
      t.x tx0, t.y ty0, t.x + t.width tx1, t.y + t.height ty1, b.x bx0, b.y by0, b.x + b.width bx1, b.y + b.height by1, t.mid_y, coalesce(kids, []) kids
    from t join b on t.document_id = b.document_id and t.page = b.page left join kids on kids.document_id = t.document_id and kids.page = t.page),
  f as (
    select distinct document_id, page, -1::bigint k, 0::bigint ti, 0::bigint bi, 0::bigint nb, 0 tord, 0 bord, ''::varchar as role, []::varchar[] ids, ''::varchar num, 0.0::double x0, 0.0::double y0, 0.0::double x1, 0.0::double y1, 0.0::double c, []::integer[] merged, false hit, []::varchar[] bids, ''::varchar into_id from p
    union all
    select document_id, page, k, ti, bi, nb, tord, bord, role,
      case when hit then list_concat(ids, list_filter(bids, lambda i: not list_contains(ids, i) and (role <> 'QUESTION' or not list_contains(kids, i)))) else ids end, case when hit then coalesce(num, bnum) else num end,
      case when hit then least(x0, bx0) else x0 end, case when hit then least(y0, by0) else y0 end, case when hit then greatest(x1, bx1) else x1 end, case when hit then greatest(y1, by1) else y1 end, case when hit then greatest(c, bc) else c end,
      case when hit then list_append(merged, bord) else merged end, hit, bids, tids[1]
    from (select *, not list_contains(merged, bord) and role = brole and coalesce(num = bnum, true) and y0 < mid_y and y1 >= mid_y - greatest(2.5 * (y1 - y0), 80) and by0 <= mid_y + greatest(2.5 * (by1 - by0), 80) and by1 > mid_y
          and (list_has_any(ids, bids) or (greatest(0, by0 - y1) <= greatest(2 * (y1 - y0), 2 * (by1 - by0), 75) and greatest(0, greatest(x0, bx0) - least(x1, bx1)) <= 600)) hit
      from (select p.*, f.merged, case when p.bi = 0 then tids else f.ids end ids, case when p.bi = 0 then tnum else f.num end num, case when p.bi = 0 then tx0 else f.x0 end x0, case when p.bi = 0 then ty0 else f.y0 end y0, case when p.bi = 0 then tx1 else f.x1 end x1, case when p.bi = 0 then ty1 else f.y1 end y1, case when p.bi = 0 then tc else f.c end c
        from f join p on p.document_id = f.document_id and p.page = f.page and p.k = f.k + 1))),
  alone as (select b.* from b anti join (select document_id, page, bord as ord from f where hit) m on m.document_id = b.document_id and m.page = b.page and m.ord = b.ord),
  whole as (select document_id, page, tord as ord, 'top' as half, role, ids as region_ids, num as display_number, x0 as x, y0 as y, x1 - x0 as width, y1 - y0 as height, c as confidence from f where k >= 0 and bi = nb - 1
    union all select t.document_id, t.page, t.ord, 'top', t.role, t.region_ids, t.display_number, t.x, t.y, t.width, t.height, t.confidence from t anti join p on p.document_id = t.document_id and p.page = t.page
    union all select document_id, page, ord + 10000, 'bottom', role, region_ids, display_number, x, y, width, height, confidence from alone),
  kept as (select distinct document_id, page, unnest(region_ids) old_id from alone),
  moved as (select document_id, page, old_id, max_by(into_id, k) new_id from (select document_id, page, k, into_id, unnest(bids) old_id from f where hit) anti join kept using (document_id, page, old_id) group by all),
  remap as (select document_id, old_id, min_by(new_id, page) new_id from moved where old_id <> new_id group by all)"""


@query("j19_stitch_split_pages", f"{STITCHED} select document_id, page, ord::integer as ord, half, role, array_to_string(region_ids, ' | ') as region_ids, display_number, x, y, width, height, round(confidence, 6) as confidence from whole")
def j19(s, d):
    whole, _ = GR.stitch_split_pages(*halves(s, d))
    return joined(whole, "region_ids").select("document_id", "page", "ord", "half", "role", "region_ids", "display_number", "x", "y", "width", "height", F.round("confidence", 6).alias("confidence"))


@query("j19_remap_edges", f"""{STITCHED}, {EDGES}
  select document_id, source_id, target_id, relationship, max(confidence)::double as confidence from (select e.document_id, coalesce(a.new_id, e.source_id) as source_id, coalesce(z.new_id, e.target_id) as target_id, relationship, confidence
    from edges e left join remap a on a.document_id = e.document_id and a.old_id = e.source_id left join remap z on z.document_id = e.document_id and z.old_id = e.target_id) where source_id <> target_id group by all""")
def j19e(s, d):
    return GR.remap_edges(edges(s, d), GR.stitch_split_pages(*halves(s, d))[1])


@query("j19_orphan_edges", f"""{STITCHED}, ends as (select document_id, page, arg_max(region_ids[1], (y, -ord)) filter (half = 'top') as id, min(y) filter (half = 'bottom') as below from whole where role = 'QUESTION' group by all)
  select w.document_id, region_ids[1] as source_id, id as target_id, 'option_of' as relationship, round(confidence, 6) as confidence from whole w join ends e on e.document_id = w.document_id and e.page = w.page where half = 'bottom' and role = 'OPTION' and id is not null and coalesce(y < below, true)""")
def j19o(s, d):
    return GR.orphan_edges(GR.stitch_split_pages(*halves(s, d))[0]).withColumn("confidence", F.round("confidence", 6))


WHITE = r"'^\s+|\s+$', '', 'g'"
#: Regions with their text completed by what continues them.
FULL = rf"""full_texts as (select r.*, case when more is null or contains(head, more) then head else regexp_replace(concat_ws(' ', head, more), {WHITE}) end as full_text
  from (select *, regexp_replace(text, {WHITE}) as head from regions) r
  left join (select document_id, target_id as region_id, string_agg(regexp_replace(text, {WHITE}), ' ' order by page, y, source_id) as more
    from (select distinct e.document_id, source_id, target_id, c.page, c.y, c.text, c.role from edges e join regions c on c.document_id = e.document_id and c.region_id = e.source_id where relationship = 'continuation_of')
    where role not in ('QUESTION', 'OPTION', 'SUBQUESTION', 'SECTION_HEADER') and regexp_replace(text, {WHITE}) <> '' group by 1, 2) m on m.document_id = r.document_id and m.region_id = r.region_id)"""


@query("j20_collect_continuations", f"{G}, {FULL} select region_id, full_text from full_texts")
def j20(s, d):
    return GR.collect_continuations(regions(s, d), edges(s, d)).select("region_id", "full_text")


OPTION_PREFIX = r"(?s)^\s*[(\[]?\s*([A-Da-d1-4])\s*[)\].:]\s*(.*)$"
OPTIONS = rf"""options as (select document_id, target_id as question_id, source_id as option_region_id, coalesce(named, chr((64 + row_number() over (partition by document_id, target_id order by page, y, x, source_id))::integer)) as label, option_text
  from (select * from (select distinct e.document_id, target_id, source_id, page, x, y, nullif(upper(regexp_extract(full_text, '{OPTION_PREFIX}', 1)), '') as named,
        case when regexp_matches(full_text, '{OPTION_PREFIX}') then regexp_replace(regexp_extract(full_text, '{OPTION_PREFIX}', 2), {WHITE}) else full_text end as option_text
      from edges e join full_texts c on c.document_id = e.document_id and c.region_id = e.source_id where relationship = 'option_of' and role not in ('QUESTION', 'SECTION_HEADER', 'HEADER', 'FOOTER') and not (role = 'UNKNOWN' and parent_region_id is not null))
    qualify option_text = '' or row_number() over (partition by document_id, target_id, lower(option_text) order by page, y, x, source_id) = 1))"""


@query("j21_attach_options", f"{G}, {FULL}, {OPTIONS} select document_id, question_id, option_region_id, label, option_text from options")
def j21(s, d):
    return GR.attach_options(regions(s, d), edges(s, d)).select("document_id", "question_id", "option_region_id", "label", "option_text")


@query("u4_dedupe_options", f"{R} select document_id, region_id from regions where role = 'OPTION' qualify text = '' or row_number() over (partition by document_id, lower(trim(text, E' \\t\\r\\n')) order by {ROW}) = 1")
def u4(s, d):
    o = regions(s, d).where("role = 'OPTION'").withColumns({"parent_id": F.lit("p"), "option_text": F.col("text")})
    return GR.dedupe_options(o).select("document_id", "region_id")


@query("u2_dedupe_edges", f"{G} select document_id, source_id, target_id, relationship, max(confidence)::double as confidence from edges group by 1, 2, 3, 4")
def u2(s, d):
    e = edges(s, d)
    return GR.dedupe_edges(e.union(e))


def verdicts(s, d):
    r = regions(s, d)
    return GR.question_verdicts(r.withColumn("text", F.when((F.col("role") == "QUESTION") & (F.col("ord") % 21 == 0), F.concat("ord", F.lit(". Answer the following :"))).otherwise(F.col("text"))))


@query("j22_attach_subquestions", f"{R} select s.document_id, s.region_id, s.document_id || '_' || (s.ord - 4) as parent_id, case when s.ord - 4 <= 999 then (s.ord - 4)::varchar else '1' end || '(b)' as number from regions s where s.ord % 7 = 4 and (s.ord - 4) % 21 <> 0")
def j22(s, d):
    r = regions(s, d)
    return GR.attach_subquestions(r, edges(s, d), verdicts(s, d)).select("document_id", "region_id", "parent_id", "number")


@query("j23_promote_children", f"{R} select document_id, region_id, case when ord - 4 <= 999 then (ord - 4)::varchar else '1' end || '(b)' as number from regions where ord % 21 = 4")
def j23(s, d):
    return GR.promote_children(regions(s, d), edges(s, d), verdicts(s, d)).select("document_id", "region_id", "number")


@query("j24_orphan_subquestions", f"{R} select document_id, region_id from regions where role = 'SUBQUESTION' and ord % 21 = 4")
def j24(s, d):
    emitted = verdicts(s, d).where("reason is null").select("document_id", "region_id")
    return GR.orphan_subquestions(regions(s, d), edges(s, d), emitted).select("document_id", "region_id")


@query("j25_region_fallback_questions", rf"""{R}, g as (select *, count(*) filter (regexp_matches(text, '^\s*(Q(uestion)?\.?\s*|Ans(wer)?\.?\s*)?\d{{1,3}}\s*[.):\-]\s*', 'i')) over (partition by document_id order by {ROW} rows unbounded preceding) as grp from regions where role in ('QUESTION', 'SUBQUESTION', 'UNKNOWN'))
  select document_id, region_id, regexp_extract(text, '^\s*(?:Q(?:uestion)?\.?\s*|Ans(?:wer)?\.?\s*)?(\d{{1,3}})\s*[.):\-]', 1, 'i') as number, text
  from (select document_id, grp, arg_min(region_id, (page, y, x, region_id)) as region_id, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' order by {ROW}) as text from g where grp > 0 group by 1, 2)""")
def j25(s, d):
    r = regions(s, d).withColumn("role", F.when(F.col("role") == "QUESTION", "UNKNOWN").otherwise(F.col("role")))
    return GR.region_fallback_questions(r)


@query("a16_extraction_audit", f"{R} select document_id, count(*) filter (role = 'SECTION_HEADER') as sections, count(*) filter (state = 'UNCERTAIN') as uncertain, count(distinct page) as pages, count(*) filter (role = 'QUESTION') as candidates, count(*) filter (role = 'QUESTION' and ord % 21 <> 0 and text not like '%:') as accepted, 0::bigint as rejected_empty, 0::bigint as rejected_fragment, count(*) filter (role = 'QUESTION' and (ord % 21 = 0 or text like '%:')) as rejected_group_parent from regions group by 1")
def a16(s, d):
    return GR.extraction_audit(verdicts(s, d), GR.attach_options(regions(s, d), edges(s, d)), regions(s, d)).drop("options")


@query("a17_graph_profile", f"{G} select document_id, 'node' as what, role as kind, count(*) as n from regions group by 1, 3 union all select document_id, 'edge', relationship, count(*) from edges group by 1, 3")
def a17(s, d):
    return GR.graph_profile(regions(s, d), edges(s, d))


@query("a18_graph_state", f"{G} select document_id, case max(r) when 4 then 'UNRESOLVED' when 0 then 'CONFIDENT' else 'PARTIAL' end as graph_state from (select document_id, case when state in ('UNCERTAIN', 'UNVERIFIED') or confidence < 0.65 then case when role <> 'UNKNOWN' then 2 else 1 end else 0 end r from regions union all select document_id, case when confidence >= 0.65 then 0 else 4 end from edges) group by 1")
def a18(s, d):
    return GR.graph_state(regions(s, d), edges(s, d))


@query("n3_edge_signals", f"{G} select relationship, case when confidence >= 0.65 then 'CONFIDENT' else 'UNRESOLVED' end as state, count(*) as n from edges group by 1, 2")
def n3(s, d):
    return GR.edge_signals(edges(s, d)).groupBy("relationship", "state").agg(F.count("*").alias("n"))


@query("n2_pack_regions", f"{R} select document_id, count(*) as n, string_agg(page || ':' || text[:100], ' | ' order by ord) as packed from regions group by 1")
def n2(s, d):
    packed = regions(s, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "page", F.struct("x", "y", "width", "height").alias("bbox"), F.substring("text", 1, 100).alias("text_snippet")))).alias("r"))
    return packed.select("document_id", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["page"], x["text_snippet"])), " | ").alias("packed"))


@query("a19_page_roles", f"{R} select document_id, page, case when count(*) filter (role = 'QUESTION') > 0 then 'QUESTION_PAGE' when count(*) filter (role in ('HEADER', 'METADATA', 'INSTRUCTION', 'FOOTER')) > 0.6 * count(*) then 'ADMINISTRATIVE' else 'MIXED' end as page_role from regions group by 1, 2")
def a19(s, d):
    return GR.page_roles(regions(s, d))


@query("a19_document_purpose", f"{R}, m as (select distinct document_id, page, case page % 3 when 0 then 'UNKNOWN' when 1 then 'EXAM' else 'ANSWER_KEY' end as p from regions) select document_id, case max_by(p, page) filter (p <> 'UNKNOWN') when 'EXAM' then 'QUESTION_PAPER' when 'ANSWER_KEY' then 'ANSWER_KEY' else 'QUESTION_PAPER' end as purpose from m group by 1")
def a19p(s, d):
    m = regions(s, d).select("document_id", "page").distinct().withColumn("document_purpose", F.expr("case page % 3 when 0 then 'UNKNOWN' when 1 then 'EXAM' else 'ANSWER_KEY' end"))
    return GR.document_purpose(regions(s, d), m)


@query("a20_semantic_completeness", f"{R} select document_id, page, case when page % 4 = 3 then 'PARTIAL' when count(*) filter (ord % 7 in (0, 1, 2, 3)) = 0 then 'FAILED' else 'COMPLETE' end as completeness from regions group by 1, 2")
def a20(s, d):
    pages = regions(s, d).select("document_id", "page").distinct().withColumn("finish_reason", F.when(F.col("page") % 4 == 3, "MAX_TOKENS").otherwise("STOP"))
    return GR.semantic_completeness(structures(s, d), pages)


@query("a21_model_cost", f"{R} select document_id, count(distinct page) as pages_considered, count(distinct page) filter (page <= 2) as pages_sent, count(distinct page) filter (page <= 2 and page % 2 = 1) as calls_succeeded, count(distinct page) filter (page <= 2 and page % 2 = 0) as calls_failed, count(*) as regions_considered, count(*) filter (page <= 2) as regions_sent from regions group by 1")
def a21(s, d):
    pages = regions(s, d).select("document_id", "page").distinct().withColumn("reason", F.when(F.col("page") % 2 == 0, "invalid_json"))
    return GR.model_cost(pages, regions(s, d), 2)


@query("h7_graph_invariants", f"{R} select document_id, region_id as id, 'unresolved_source' as violation from regions where ord % 7 = 4 and ord % 3 = 0 union all select document_id, region_id, 'missing_parent' from regions where ord % 7 = 4 and ord % 5 = 0 union all select document_id, region_id, 'missing_edge' from regions where ord % 7 = 4 and (ord % 5 = 0 or ord % 3 = 0)")
def h7(s, d):
    q = regions(s, d).where("ord % 7 = 4").select("document_id", F.col("region_id").alias("id"), F.when(F.col("ord") % 3 == 0, "gone").otherwise(F.col("region_id")).alias("source_id"), F.when(F.col("ord") % 5 == 0, "gone").otherwise(F.concat("document_id", F.lit("_"), F.col("ord") - 4)).alias("parent_id"))
    return GR.graph_invariants(q, regions(s, d), edges(s, d))


@query("h8_graph_anomalies", rf"""{G}, parents as (select document_id, source_id as region_id, count(distinct target_id) as n from edges where relationship in ('option_of', 'subquestion_of') group by 1, 2)
  select document_id, 'self_loop' as what, source_id as id from edges where source_id = target_id union all select document_id, 'duplicate_edge', source_id from edges group by document_id, source_id, target_id, relationship having count(*) > 1
  union all select document_id, case when n is null then 'no_parent' else 'many_parents' end, region_id from regions left join parents using (document_id, region_id) where role in ('OPTION', 'SUBQUESTION') and (n is null or n > 1)
  union all select document_id, 'one_word_question', region_id from regions where role = 'QUESTION' and not regexp_matches(trim(text, E' \t\n\r'), '\s')
  union all select e.document_id, 'suspicious_continuation', source_id from edges e join regions a on a.document_id = e.document_id and a.region_id = source_id
    where relationship = 'continuation_of' and a.role in ({", ".join(f"'{x}'" for x in GR.BOUNDARY)})""")  # fmt: skip
def h8(s, d):
    return GR.graph_anomalies(regions(s, d), edges(s, d))


@query("h9_source_fidelity", f"{R} select document_id, region_id as id, 'text_differs' as violation from regions where role = 'QUESTION' and ord % 2 = 1")
def h9(s, d):
    q = regions(s, d).where("role = 'QUESTION'").select("document_id", F.col("region_id").alias("id"), F.when(F.col("ord") % 2 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"), F.array("region_id").alias("source_ids"))
    return GR.source_fidelity(q, regions(s, d))


@query("h10_stage_trace", f"""{G}, {FULL}, {OPTIONS} select document_id, region_id, page, case when role = 'QUESTION' then case when ord % 21 = 0 or text like '%:' then 'rejected:group_parent' else 'question' end
    when region_id in (select option_region_id from options) then 'option' when role = 'SECTION_HEADER' then 'section' when parent_region_id is not null then 'continuation' else 'none' end as disposition from regions""")
def h10(s, d):
    r = regions(s, d)
    return GR.stage_trace(r, verdicts(s, d), GR.attach_options(r, edges(s, d)))
