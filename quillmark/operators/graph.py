"""Structure graphs: page models, edges, question extraction, audits. nodes: document_id, region_id, page, ord, x, y, width,
height, text, role, confidence, state, parent_region_id; edges: document_id, source_id, target_id, relationship, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import has, once, ordered, strip
from quillmark.operators.regions import box_scores, display_number, is_fragment, is_group_parent

ROLES = ("QUESTION", "SUBQUESTION", "OPTION", "SECTION_HEADER", "INSTRUCTION", "HEADER", "FOOTER", "METADATA", "DIAGRAM", "TABLE", "ANSWER_REGION", "HANDWRITING", "UNKNOWN")
SYNONYMS = {"ADMINISTRATIVE": "INSTRUCTION", "CONTINUATION": "UNKNOWN"}
RELATIONS = ("option_of", "subquestion_of", "continuation_of", "follows", "belongs_to", "section_member")
BOUNDARY = ("QUESTION", "OPTION", "SUBQUESTION", "SECTION_HEADER")
WEIGHTS = {"parser": 0.85, "layout_analyzer": 0.80, "semantic_analyzer": 0.75, "vlm": 0.90, "vlm_page_understanding": 0.70}
KEY = ("document_id", "region_id")


def vocabulary_check(role: Column, relation: Column) -> tuple[Column, Column]:
    r = F.upper(strip(F.coalesce(role, F.lit(""))))
    for a, b in SYNONYMS.items():
        r = F.when(r == a, b).otherwise(r)
    e = F.lower(strip(F.coalesce(relation, F.lit(""))))
    return F.when(r.isin(*ROLES), r).otherwise("UNKNOWN"), F.when(e.isin(*RELATIONS), e).otherwise("belongs_to")


def side(nodes: DataFrame, end: str, *columns: str) -> DataFrame:
    return nodes.select("document_id", F.col("region_id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_known"), *(F.col(c).alias(f"{end}_{c}") for c in columns))


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    return edges.join(side(nodes, "source", *columns), ["document_id", "source_id"], "left").join(side(nodes, "target", *columns), ["document_id", "target_id"], "left")


def edge_spatial_validity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Option and part edges only to a question at most 25 pixels below."""
    rows = with_ends(edges, nodes, "role", "y")
    ok = ~F.col("relationship").isin("option_of", "subquestion_of") | ((F.col("target_role") == "QUESTION") & (F.col("target_y") <= F.col("source_y") + 25))
    return rows.where(F.coalesce(ok, F.lit(False))).select(edges.columns)


def edge_consistency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with reason: null for one that may stay."""
    back = edges.where("relationship in ('follows', 'continuation_of')").select("document_id", F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), "relationship", F.lit(True).alias("both_ways")).distinct()
    rows = with_ends(edges, nodes, "page", "y", "text").join(back, ["document_id", "source_id", "target_id", "relationship"], "left")
    up = (F.col("source_page") < F.col("target_page")) | ((F.col("source_page") == F.col("target_page")) & (F.col("source_y") < F.col("target_y") - 10))
    numbered = lambda c: has(F.col(c), r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?\d{1,3}\s*[.):]")
    reason = (F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "missing_id").when(F.col("source_known").isNull() | F.col("target_known").isNull(), "unknown_region").when(F.col("source_id") == F.col("target_id"), "self_link")
              .when(F.col("both_ways"), "bidirectional_loop").when((F.col("relationship") == "follows") & up, "inverted_follows").when((F.col("relationship") == "continuation_of") & up, "inverted_continuation")
              .when((F.col("relationship") == "continuation_of") & numbered("source_text") & numbered("target_text"), "continuation_between_questions"))
    return rows.withColumn("reason", reason).select(*edges.columns, "reason")


def prune_stale_continuations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges has evidence_sources. Continuations from a region with a role go, and those from none into one that no model confirms."""
    rows = with_ends(edges, nodes, "role")
    source, target = F.coalesce("source_role", F.lit("UNKNOWN")), F.coalesce("target_role", F.lit("UNKNOWN"))
    confirmed = F.coalesce(F.array_contains("evidence_sources", "visual_vlm_verification"), F.lit(False))
    stale = (F.col("relationship") == "continuation_of") & (source.isin(*BOUNDARY) | ((source == "UNKNOWN") & target.isin(*BOUNDARY) & ~confirmed))
    return rows.where(~stale).select(edges.columns)


def demote_unclaimed(nodes: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """pages: document_id, page, completeness; claims: document_id, region_id."""
    rows = nodes.join(pages.select("document_id", "page", "completeness"), ["document_id", "page"], "left").join(claims.select("document_id", "region_id", F.lit(True).alias("claimed")).distinct(), list(KEY), "left")
    roles = F.col("role").isin("QUESTION", "OPTION", "SUBQUESTION")
    c, free = F.coalesce("completeness", F.lit("")), F.col("claimed").isNull()
    gone, unsure, failed = roles & free & (c == "COMPLETE"), roles & free & c.isin("AMBIGUOUS", "PARTIAL"), roles & (c == "FAILED")
    cap = F.when(gone, 0.40).when(unsure, 0.55).when(failed, 0.50).otherwise(1.0)
    return rows.withColumns({"confidence": F.least("confidence", cap), "state": F.when(gone, "UNVERIFIED").when(unsure | failed, "UNCERTAIN").otherwise(F.col("state")), "role": F.when(gone, "UNKNOWN").otherwise(F.col("role"))}).select(nodes.columns)


NO_IDS = "array<string>"
CLAIMS = "array<struct<ord: int, region_id: string, claim: string, head_id: string>>"


def claim_regions(structures: DataFrame, nodes: DataFrame) -> DataFrame:
    """Which structure of a page claims a region, and as what: document_id, page, ord, region_id, claim, head_id.

    structures: document_id, page, ord, region_ids, x, y, width, height (no height: no box). They claim in order, one page a
    fold whose accumulator holds the regions that are taken. A structure whose first id is free has it as head, and those of
    its other ids as continuations that are free, no structure's head and near enough. One whose head is taken, or that names
    none, claims by its box what fits of the free regions; where nothing does, it stands for itself (claim visual). A region
    that doesn't exist can be named but not taken. Without ids and box a structure claims nothing.

    How well regions fit a box doesn't depend on claims, so it is joined beforehand (``box_scores``); only the choice is
    made in the fold. What is collected for a task is one page.
    """
    page = ["document_id", "page"]
    known = nodes.select(*KEY, F.col("y").alias("at"))
    named = structures.select(*page, "ord", F.posexplode("region_ids").alias("place", "region_id")).join(known, list(KEY), "left")
    ids = named.groupBy(*page, "ord").agg(F.array_sort(F.collect_list(F.struct("place", "region_id", "at"))).alias("ids"))
    boxes = structures.where("height is not null").select(*page, F.col("ord").alias("box_id"), "x", "y", "width", "height")
    fits = box_scores(boxes, nodes).groupBy(*page, F.col("box_id").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "region_id", "score"))).alias("fits"))
    each = structures.select(*page, F.col("ord").cast("int").alias("ord"), "height", "y").join(ids, [*page, "ord"], "left").join(fits, [*page, "ord"], "left")
    pages = each.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("ord", "height", "y", "ids", "fits"))).alias("all"))
    heads = F.transform(F.filter("all", lambda s: F.coalesce(F.size(s["ids"]), F.lit(0)) > 0), lambda s: s["ids"][0]["region_id"])

    def claim(acc: Column, s: Column) -> Column:
        free = lambda c: ~F.array_contains(acc["taken"], c["region_id"])
        first = F.get(s["ids"], F.lit(0))
        by_id = F.coalesce((F.size(s["ids"]) > 0) & free(first), F.lit(False))
        head_y = F.coalesce(first["at"], s["y"], F.lit(0.0))
        reach = F.when(s["height"].isNull(), 200.0).otherwise(F.greatest(s["height"], F.lit(150.0)))
        near = lambda c: F.coalesce(F.abs(c["at"] - head_y) <= reach, F.lit(True))
        more = F.filter(F.slice(s["ids"], 2, 1 << 20), lambda c: free(c) & ~F.array_contains("heads", c["region_id"]) & near(c))
        open_ = F.filter(F.coalesce(s["fits"], F.array().cast("array<struct<y: double, x: double, region_id: string, score: double>>")), free)
        top = F.array_max(F.transform(open_, lambda c: c["score"]))
        kept = F.filter(open_, lambda c: c["score"] >= F.greatest(F.lit(0.2), top * 0.5))
        got = F.when(by_id, F.concat(F.array(first["region_id"]), F.transform(more, lambda c: c["region_id"]))).otherwise(F.transform(kept, lambda c: c["region_id"]))
        exist = F.when(by_id, F.transform(F.filter(s["ids"], lambda c: c["at"].isNotNull()), lambda c: c["region_id"])).otherwise(got)
        visual = ~by_id & s["height"].isNotNull() & (F.size(got) == 0)
        itself = F.concat(F.lit("visual_"), F.col("page"), F.lit("_"), s["ord"])
        rows = F.transform(got, lambda c, i: F.struct(s["ord"].alias("ord"), c.alias("region_id"), F.when(i == 0, "head").otherwise("continuation").alias("claim"), got[0].alias("head_id")))
        rows = F.when(visual, F.array(F.struct(s["ord"].alias("ord"), itself.alias("region_id"), F.lit("visual").alias("claim"), itself.alias("head_id")))).otherwise(rows)
        return F.struct(F.concat(acc["taken"], F.array_intersect(got, exist)).alias("taken"), F.concat(acc["rows"], rows.cast(CLAIMS)).alias("rows"))

    begin = F.struct(F.array().cast(NO_IDS).alias("taken"), F.array().cast(CLAIMS).alias("rows"))
    done = pages.withColumn("heads", heads).select(*page, F.explode_outer(F.aggregate("all", begin, claim)["rows"]).alias("c")).where("c is not null")
    return done.select(*page, "c.ord", "c.region_id", "c.claim", "c.head_id")


def apply_model_roles(nodes: DataFrame, claims: DataFrame, structures: DataFrame) -> DataFrame:
    """Heads get their structure's role where it is sure enough; continuations belong to their head."""
    s = structures.select("document_id", "page", "ord", F.col("role").alias("model_role"), F.col("confidence").alias("model_conf"))
    rows = nodes.join(claims.select("document_id", "page", "ord", "region_id", "claim", "head_id").join(s, ["document_id", "page", "ord"]).drop("page", "ord"), list(KEY), "left")
    head, cont = F.col("claim") == "head", F.coalesce(F.col("claim") == "continuation", F.lit(False))
    sure = F.coalesce(head & (F.col("model_conf") >= 0.60) & (F.col("model_role") != "UNKNOWN"), F.lit(False))
    return rows.withColumns({"role": F.when(sure, F.col("model_role")).when(cont, "UNKNOWN").otherwise(F.col("role")), "confidence": F.when(sure, F.col("model_conf")).otherwise(F.col("confidence")), "state": F.when(sure | cont, "VERIFIED").when(head, "UNCERTAIN").otherwise(F.col("state")), "parent_region_id": F.when(cont, F.col("head_id")).otherwise(F.col("parent_region_id"))}).select(nodes.columns)


def fuse_region_hypotheses(regions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Fused type, confidence and state. regions: document_id, region_id, region_type, confidence; hypotheses: keys, type, confidence, source."""
    w = F.lit(0.70)
    for source, weight in WEIGHTS.items():
        w = F.when(F.col("source") == source, weight).otherwise(w)
    by_type = hypotheses.groupBy(*KEY, "type").agg((F.sum(F.col("confidence") * w) / F.sum(w)).alias("score"), F.max(F.when(F.col("source") == "vlm", F.col("confidence"))).alias("vlm"))
    packed = by_type.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "type", "score", "vlm"))).alias("s"), F.max("vlm").alias("vlm"))
    rows = regions.join(packed, list(KEY), "left")
    top, second, given = F.col("s")[0], F.get("s", F.lit(1)), F.col("vlm").isNotNull()
    conflict = F.coalesce((top["score"] >= 0.70) & (second["score"] >= 0.70), F.lit(False))
    four = lambda c: F.bround(F.least(F.lit(1.0), c), 4)
    base = four(0.4 * F.col("confidence") + 0.6 * top["score"] * F.when(conflict, 0.85).otherwise(1.0))
    agreed = given & (top["vlm"].isNotNull()) & (top["score"] >= 0.75) & ~conflict
    state = (F.when(F.col("s").isNull(), "UNVERIFIED").when(conflict, "CONFLICTED").when(agreed, "VERIFIED").when(given, F.when(top["score"] >= 0.80, "VERIFIED").otherwise("UNCERTAIN"))
             .when(top["score"] >= 0.85, "VERIFIED").when(top["score"] < 0.60, "UNCERTAIN").otherwise("UNVERIFIED"))
    conf = F.when(F.col("s").isNull(), F.col("confidence")).when(agreed, four(F.greatest(base, F.col("vlm")) + 0.05)).otherwise(base)
    return rows.select(*KEY, F.coalesce(top["type"], "region_type").alias("region_type"), conf.alias("confidence"), state.alias("verification_state"), conflict.alias("classification_conflict"))


def verification_summary(fused: DataFrame) -> DataFrame:
    return fused.groupBy("document_id").agg(F.count("*").alias("total_regions"), *(F.count_if(F.col("verification_state") == s).alias(f"{s.lower()}_count") for s in ("VERIFIED", "CONFLICTED", "UNCERTAIN", "UNVERIFIED")))


STITCHED = "ord int, role string, region_ids array<string>, display_number string, display_label string, x double, y double, width double, height double, confidence double"
#: Roles whose structures don't take the ids of options and parts when they grow.
PARENTS = ("QUESTION", "SECTION_HEADER", "INSTRUCTION")


def stitch_split_pages(top: DataFrame, bottom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structures of whole pages with half top or bottom, the map of bottom region ids to the head they joined).

    top, bottom: document_id, page, ord, role, region_ids, display_number, x, y, width, height, confidence, mid_y and, if
    there is one, display_label; bottom boxes are relative to mid_y. In order, each top structure takes the bottom ones that
    no earlier one has taken, of its role, with numbers and labels that agree, at the seam, and that share an id with it or
    lie near it. It grows with each: later ones are compared with its hull, its ids, its number and its label. A top
    structure of a role in PARENTS doesn't take ids that an option or a part of the bottom has. An id that several merged
    structures have goes to the one merged last; one that an unmerged structure has stays.

    Two nested folds over the halves of one page, which is what is collected for a task.
    """
    page = ["document_id", "page"]
    full = lambda d: d if "display_label" in d.columns else d.withColumn("display_label", F.lit(None).cast("string"))
    shape = [c.split()[0] for c in STITCHED.split(", ")]
    array = f"array<struct<{STITCHED.replace(' ', ': ').replace(',:', ',')}>>"
    packed = lambda d, name: d.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), *shape[1:]))).cast(array).alias(name), F.max("mid_y").alias(f"mid_{name}"))
    pages = packed(full(top), "tops").join(packed(full(bottom).withColumn("y", F.col("y") + F.col("mid_y")), "bottoms"), page, "full")
    none = F.array().cast(array)
    pages = pages.select(*page, F.coalesce("tops", none).alias("tops"), F.coalesce("bottoms", none).alias("bottoms"), F.coalesce("mid_tops", "mid_bottoms").alias("mid_y"))
    ids_of = lambda some: F.flatten(F.transform(some, lambda s: s["region_ids"]))
    pages = pages.withColumn("child_ids", ids_of(F.filter("bottoms", lambda s: s["role"].isin("OPTION", "SUBQUESTION"))))
    end = lambda s, at, size: s[at] + s[size]
    reach = lambda s: F.greatest(s["height"] * 2.5, F.lit(80.0))
    agree = lambda t, b, c: F.coalesce((F.nullif(t[c], F.lit("")) == F.nullif(b[c], F.lit(""))), F.lit(True))

    def fits(t: Column, b: Column) -> Column:
        mid = F.col("mid_y")
        seam = (t["y"] < mid) & (end(t, "y", "height") >= mid - reach(t)) & (b["y"] <= mid + reach(b)) & (end(b, "y", "height") > mid)
        gap = F.greatest(F.lit(0.0), b["y"] - end(t, "y", "height")) <= F.greatest(t["height"] * 2, b["height"] * 2, F.lit(75.0))
        beside = F.greatest(F.lit(0.0), F.greatest(t["x"], b["x"]) - F.least(end(t, "x", "width"), end(b, "x", "width"))) <= 600
        shared = F.arrays_overlap(t["region_ids"], b["region_ids"])
        return F.coalesce((t["role"] == b["role"]) & (t["role"] != "UNKNOWN") & agree(t, b, "display_number") & agree(t, b, "display_label") & seam & (shared | (gap & beside)), F.lit(False))

    def grown(t: Column, b: Column) -> Column:
        x, y = F.least(t["x"], b["x"]), F.least(t["y"], b["y"])
        more = F.when(t["role"].isin(*PARENTS), F.array_except(b["region_ids"], "child_ids")).otherwise(b["region_ids"])
        first = lambda c: F.coalesce(F.nullif(t[c], F.lit("")), b[c])
        parts = {"ord": t["ord"], "role": t["role"], "region_ids": F.concat(t["region_ids"], F.array_except(more, t["region_ids"])), "display_number": first("display_number"), "display_label": first("display_label"), "x": x, "y": y}
        parts |= {"width": F.greatest(end(t, "x", "width"), end(b, "x", "width")) - x, "height": F.greatest(end(t, "y", "height"), end(b, "y", "height")) - y, "confidence": F.greatest(t["confidence"], b["confidence"])}
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    merge = "struct<ord: int, into: string>"

    def stitch(acc: Column, t: Column) -> Column:
        def take(inner: Column, b: Column) -> Column:
            ok = ~F.exists(inner["merged"], lambda m: m["ord"] == b["ord"]) & fits(inner["top"], b)
            one = F.struct(b["ord"].alias("ord"), F.get(t["region_ids"], F.lit(0)).alias("into")).cast(merge)
            return F.struct(F.when(ok, grown(inner["top"], b)).otherwise(inner["top"]).cast(array[6:-1]).alias("top"), F.when(ok, F.concat(inner["merged"], F.array(one))).otherwise(inner["merged"]).alias("merged"))

        inner = F.aggregate("bottoms", F.struct(t.cast(array[6:-1]).alias("top"), acc["merged"].alias("merged")), take)
        return F.aggregate(F.array(inner), F.struct(acc["tops"].alias("tops"), acc["merged"].alias("merged")), lambda a, i: F.struct(F.concat(a["tops"], F.array(i["top"])).alias("tops"), i["merged"].alias("merged")))

    begin = F.struct(none.alias("tops"), F.array().cast(f"array<{merge}>").alias("merged"))
    alone = lambda merged: F.filter("bottoms", lambda b: ~F.exists(merged, lambda m: m["ord"] == b["ord"]))
    done = pages.withColumn("done", once(F.aggregate("tops", begin, stitch), lambda d: F.struct(d["tops"].alias("tops"), d["merged"].alias("merged"), alone(d["merged"]).alias("alone"))))
    half = lambda some, name, shift: F.transform(some, lambda s: F.struct((s["ord"] + shift).alias("ord"), *(s[c].alias(c) for c in shape[1:]), F.lit(name).alias("half")))
    # outer: for a plain explode Spark filters by the list's size first, which folds the page twice
    both = F.explode_outer(F.concat(half("done.tops", "top", 0), half("done.alone", "bottom", 10_000)))
    whole = done.select(*page, both.alias("s")).where("s is not null").select(*page, "s.*")
    moved = done.select(*page, ids_of(F.col("done.alone")).alias("kept"), "bottoms", F.posexplode_outer("done.merged").alias("turn", "m")).where("m is not null")
    ids = F.get(F.filter("bottoms", lambda b: b["ord"] == F.col("m.ord")), F.lit(0))["region_ids"]
    moved = moved.select(*page, "turn", F.col("m.into").alias("new_id"), F.explode(F.array_except(ids, "kept")).alias("old_id")).where("new_id is not null")
    remap = moved.groupBy(*page, "old_id").agg(F.max_by("new_id", "turn").alias("new_id")).where("old_id <> new_id")
    return whole, remap.select("document_id", "page", "old_id", "new_id")


def orphan_edges(whole: DataFrame) -> DataFrame:
    """Edges of bottom options and parts above the first bottom question to the lowest top question of their page.

    whole: as of ``stitch_split_pages``. Of top questions equally low the first counts; one without ids takes none.
    """
    w = Window.partitionBy("document_id", "page")
    asks = (F.col("role") == "QUESTION") & F.col("y").isNotNull()
    part = F.expr("half = 'bottom' and role in ('OPTION', 'SUBQUESTION') and size(region_ids) > 0")
    rows = whole.where(asks | part).where("document_id is not null and page is not null").select("document_id", "page", "ord", "half", "role", "y", "confidence", F.get("region_ids", F.lit(0)).alias("id"))
    last = F.max_by(F.struct("id"), F.when(asks & (F.col("half") == "top"), F.struct("y", -F.col("ord")))).over(w)
    parts = rows.withColumns({"last": last, "below": F.min(F.when(asks & (F.col("half") == "bottom"), F.col("y"))).over(w)}).where("half = 'bottom' and role in ('OPTION', 'SUBQUESTION')")
    free = parts.where((F.col("last.id").isNotNull()) & F.coalesce(F.col("y") < F.col("below"), F.lit(True)))
    return free.select("document_id", F.col("id").alias("source_id"), F.col("last.id").alias("target_id"), F.concat(F.lower("role"), F.lit("_of")).alias("relationship"), "confidence")


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges by the ids that structures have after stitching (of several pages the first); without self-links and repeats."""
    one = remap.groupBy("document_id", "old_id").agg(F.min_by("new_id", "page").alias("new_id"))
    to = lambda end: one.select("document_id", F.col("old_id").alias(f"{end}_id"), F.col("new_id").alias(f"{end}_new"))
    rows = edges.join(to("source"), ["document_id", "source_id"], "left").join(to("target"), ["document_id", "target_id"], "left")
    rows = rows.select("document_id", F.coalesce("source_new", "source_id").alias("source_id"), F.coalesce("target_new", "target_id").alias("target_id"), "relationship", "confidence")
    return dedupe_edges(rows.where("source_id <> target_id"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first, most confident of each (source, target, relationship)."""
    return edges.groupBy("document_id", "source_id", "target_id", "relationship").agg(F.max("confidence").alias("confidence"))


def children(edges: DataFrame, nodes: DataFrame, relationship: str) -> DataFrame:
    """The nodes that stand in a relationship to another: document_id, parent_id and the child's columns."""
    e = edges.where(F.col("relationship") == relationship).select("document_id", F.col("source_id").alias("region_id"), F.col("target_id").alias("parent_id")).distinct()
    return e.join(nodes, list(KEY))


def collect_continuations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The text of each region that continuations without a role of their own complete, in (page, y)."""
    parts = children(edges, nodes, "continuation_of").where(~F.col("role").isin(*BOUNDARY) & (strip(F.col("text")) != ""))
    more = parts.groupBy("document_id", F.col("parent_id").alias("region_id")).agg(F.array_join(ordered(strip(F.col("text")), "page", "y", "region_id"), " ").alias("more"))
    rows = nodes.join(more, list(KEY), "left")
    head = strip(F.col("text"))
    return rows.withColumn("full_text", F.when(F.col("more").isNull() | head.contains(F.col("more")), head).otherwise(strip(F.concat_ws(" ", head, "more"))))


def attach_options(nodes: DataFrame, edges: DataFrame, row_bodies: DataFrame | None = None) -> DataFrame:
    """Options of each question: label, text; equal bodies once. row_bodies: document_id, option_id, body (for bare labels)."""
    full = collect_continuations(nodes, edges)
    child = children(edges, full, "option_of").where(~F.col("role").isin("QUESTION", "SECTION_HEADER", "HEADER", "FOOTER") & ~((F.col("role") == "UNKNOWN") & F.col("parent_region_id").isNotNull()))
    if row_bodies is not None:
        child = child.join(row_bodies.select("document_id", F.col("option_id").alias("region_id"), "body"), list(KEY), "left").withColumn("full_text", strip(F.concat_ws(" ", "full_text", "body")))
    prefix = r"(?s)^\s*[(\[]?\s*([A-Da-d1-4])\s*[)\].:]\s*(.*)$"
    body = F.when(has(F.col("full_text"), prefix), strip(F.regexp_extract("full_text", prefix, 2))).otherwise(F.col("full_text"))
    rows = dedupe_options(child.withColumns({"named": F.nullif(F.upper(F.regexp_extract("full_text", prefix, 1)), F.lit("")), "option_text": body}))
    w = Window.partitionBy("document_id", "parent_id").orderBy("page", "y", "x", "region_id")
    return rows.select("document_id", F.col("parent_id").alias("question_id"), F.col("region_id").alias("option_region_id"), F.coalesce("named", F.char(64 + F.row_number().over(w))).alias("label"), "option_text", "confidence")


def dedupe_options(options: DataFrame) -> DataFrame:
    """The first of options with one normalised body within a question; empty bodies all stay."""
    w = Window.partitionBy("document_id", "parent_id", F.lower(strip(F.col("option_text")))).orderBy("page", "y", "x", "region_id")
    return options.withColumn("r", F.row_number().over(w)).where("r = 1 or option_text = ''").drop("r")


def question_verdicts(nodes: DataFrame) -> DataFrame:
    """Question nodes with number, and reason: null for one to emit."""
    q = nodes.where("role = 'QUESTION'")
    reason = F.when(strip(F.col("text")) == "", "empty").when(is_fragment(F.col("text")), "fragment").when(is_group_parent(F.col("text")), "group_parent")
    return q.withColumns({"number": display_number(F.col("text"), F.lit(None).cast("string")), "reason": reason})


def attach_subquestions(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Parts of emitted questions, numbered parent(label)."""
    parents = verdicts.where("reason is null").select("document_id", F.col("region_id").alias("parent_id"), F.col("number").alias("parent_number"))
    rows = children(edges, nodes, "subquestion_of").join(parents, ["document_id", "parent_id"])
    label = F.lower(F.regexp_extract("text", r"(?i)^\s*[(\[]?\s*([a-z]{1,4})\s*[)\].:]", 1))
    return rows.select("document_id", "region_id", "parent_id", F.concat(F.coalesce("parent_number", F.lit("1")), F.lit("("), label, F.lit(")")).alias("number"), "text", "confidence")


def promote_children(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Parts of rejected group parents, as questions of their own."""
    parents = verdicts.where("reason = 'group_parent'").select("document_id", F.col("region_id").alias("parent_id"), F.col("number").alias("parent_number"))
    rows = children(edges, nodes, "subquestion_of").join(parents, ["document_id", "parent_id"])
    return rows.select("document_id", "region_id", "parent_id", display_number(F.col("text"), F.coalesce("parent_number", F.lit("1"))).alias("number"), "text", "confidence")


def orphan_subquestions(nodes: DataFrame, edges: DataFrame, emitted: DataFrame) -> DataFrame:
    """Parts that weren't emitted and whose parent wasn't either. emitted: document_id, region_id."""
    parts = nodes.where("role = 'SUBQUESTION'").join(emitted.select(*KEY), list(KEY), "left_anti")
    safe = edges.where("relationship = 'subquestion_of'").join(emitted.select("document_id", F.col("region_id").alias("target_id")), ["document_id", "target_id"], "left_semi").select("document_id", F.col("source_id").alias("region_id")).distinct()
    return parts.join(safe, list(KEY), "left_anti")


def region_fallback_questions(nodes: DataFrame) -> DataFrame:
    """For documents without a question node: a line that starts one begins a group that the following lines join."""
    with_question = nodes.where("role = 'QUESTION'").select("document_id").distinct()
    rows = nodes.join(with_question, "document_id", "left_anti")
    starts = has(F.col("text"), r"(?i)^\s*(?:Q(?:uestion)?\.?\s*|Ans(?:wer)?\.?\s*)?\d{1,3}\s*[.):\-]\s*")
    order = Window.partitionBy("document_id").orderBy("page", "y", "x", "region_id")
    rows = rows.where("role not in ('HEADER', 'FOOTER', 'OPTION', 'SECTION_HEADER', 'INSTRUCTION')").withColumn("group", F.count_if(starts).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("group > 0")
    out = rows.groupBy("document_id", "group").agg(F.min_by("region_id", F.struct("page", "y", "x", "region_id")).alias("region_id"), F.array_join(ordered(strip(F.col("text")), "page", "y", "x", "region_id"), " ").alias("text"))
    return out.select("document_id", "region_id", display_number(F.col("text"), F.lit("1")).alias("number"), "text")


def extraction_audit(verdicts: DataFrame, options: DataFrame, nodes: DataFrame) -> DataFrame:
    q = verdicts.groupBy("document_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("reason").isNull()).alias("accepted"), *(F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in ("empty", "fragment", "group_parent")))
    o = options.groupBy("document_id").agg(F.count("*").alias("options"))
    n = nodes.groupBy("document_id").agg(F.count_if(F.col("role") == "SECTION_HEADER").alias("sections"), F.count_if(F.col("state") == "UNCERTAIN").alias("uncertain"), F.count_distinct("page").alias("pages"))
    rows = n.join(q, "document_id", "left").join(o, "document_id", "left")
    return rows.select("document_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns if c != "document_id"))


def graph_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form: what is counted, of which kind, how many, by document."""
    return nodes.groupBy("document_id", F.lit("node").alias("what"), F.col("role").alias("kind")).agg(F.count("*").alias("n")).union(edges.groupBy("document_id", F.lit("edge"), "relationship").agg(F.count("*")))


def node_state(nodes: DataFrame) -> Column:
    unsure = F.col("state").isin("UNCERTAIN", "UNVERIFIED") | (F.col("confidence") < 0.65)
    return F.when(F.coalesce(F.col("conflict"), F.lit(False)) if "conflict" in nodes.columns else F.lit(False), "PARTIAL").when(unsure, F.when(F.col("role") != "UNKNOWN", "PARTIAL").otherwise("UNKNOWN")).otherwise("CONFIDENT")


STATES = ("CONFIDENT", "UNKNOWN", "PARTIAL", "AMBIGUOUS", "UNRESOLVED", "CONFLICTING")


def graph_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The worst state among a document's nodes and edges; UNKNOWN counts as PARTIAL."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c)
    edge = F.when(F.col("confidence") >= 0.65, "CONFIDENT").otherwise("UNRESOLVED")
    every = nodes.select("document_id", rank(node_state(nodes)).alias("r")).union(edges.select("document_id", rank(edge)))
    worst = F.get(F.array(*map(F.lit, STATES)), (F.max("r") - 1).cast("int"))
    return every.groupBy("document_id").agg(worst.alias("s")).select("document_id", F.when(F.col("s") == "UNKNOWN", "PARTIAL").otherwise(F.col("s")).alias("graph_state"))


def edge_signals(edges: DataFrame) -> DataFrame:
    return edges.withColumn("state", F.when(F.col("confidence") >= 0.65, "CONFIDENT").otherwise("UNRESOLVED"))


PURPOSES = {"EXAMINATION_PAPER": "QUESTION_PAPER", "QUESTION_PAPER": "QUESTION_PAPER", "EXAM": "QUESTION_PAPER", "ASSIGNMENT": "QUESTION_PAPER", "INSTRUCTIONS": "INSTRUCTIONS", "COVER": "COVER", "ANSWER_KEY": "ANSWER_KEY", "REFERENCE": "REFERENCE"}


def page_roles(nodes: DataFrame, model_pages: DataFrame | None = None) -> DataFrame:
    pages = nodes.groupBy("document_id", "page").agg(F.count_if(F.col("role") == "QUESTION").alias("q"), (F.count_if(F.col("role").isin("HEADER", "METADATA", "INSTRUCTION", "FOOTER")) / F.count("*")).alias("admin"))
    role = F.when(F.col("q") > 0, "QUESTION_PAGE").when(F.col("admin") > 0.6, "ADMINISTRATIVE").otherwise("MIXED")
    if model_pages is None:
        return pages.select("document_id", "page", role.alias("page_role"))
    said = model_pages.select("document_id", "page", F.when(F.col("page_purpose") != "UNKNOWN", F.col("page_purpose")).alias("said"))
    return pages.join(said, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("said", role).alias("page_role"))


def document_purpose(nodes: DataFrame, model_pages: DataFrame) -> DataFrame:
    """The last page's known purpose, mapped; else a question paper if there is any question."""
    mapped = F.create_map(*(F.lit(x) for kv in PURPOSES.items() for x in kv))
    said = model_pages.where("document_purpose <> 'UNKNOWN'").groupBy("document_id").agg(F.max_by("document_purpose", "page").alias("raw"))
    any_q = nodes.groupBy("document_id").agg(F.bool_or(F.col("role") == "QUESTION").alias("any"))
    return any_q.join(said, "document_id", "left").select("document_id", F.coalesce(F.try_element_at(mapped, "raw"), F.when(F.col("any"), "QUESTION_PAPER").otherwise("UNKNOWN")).alias("purpose"))


def semantic_completeness(structures: DataFrame, pages: DataFrame) -> DataFrame:
    """pages: document_id, page, finish_reason."""
    said = structures.groupBy("document_id", "page").agg(F.collect_set(F.when(~F.col("role").isin("HEADER", "FOOTER", "METADATA", "UNKNOWN"), F.col("role"))).alias("roles"), F.count("*").alias("n"))
    rows = pages.join(said, ["document_id", "page"], "left")
    any_of = lambda *r: F.coalesce(F.arrays_overlap("roles", F.array(*map(F.lit, r))), F.lit(False))
    answers = ("QUESTION", "OPTION", "SUBQUESTION", "ANSWER_REGION", "HANDWRITING", "TABLE")
    reason = F.coalesce("finish_reason", F.lit(""))
    return rows.select("document_id", "page", F.when(reason.isin("MAX_TOKENS", "LENGTH", "RECITATION"), "PARTIAL").when(F.coalesce("n", F.lit(0)) == 0, "FAILED").when(~reason.isin("STOP", "stop", "", "N/A"), "AMBIGUOUS").when(any_of(*answers), "COMPLETE").when(any_of("SECTION_HEADER", "INSTRUCTION") & (F.size("roles") >= 2), "COMPLETE").otherwise("AMBIGUOUS").alias("completeness"))


def model_cost(pages: DataFrame, nodes: DataFrame, most: int = 6) -> DataFrame:
    """Pages and regions that were considered and sent, calls and their outcome. pages: document_id, page, reason (null: success)."""
    p = pages.groupBy("document_id").agg(F.count("*").alias("pages_considered"), F.count_if(F.col("page") <= most).alias("pages_sent"), F.count_if((F.col("page") <= most) & F.col("reason").isNull()).alias("calls_succeeded"), F.count_if((F.col("page") <= most) & F.col("reason").isNotNull()).alias("calls_failed"))
    n = nodes.groupBy("document_id").agg(F.count("*").alias("regions_considered"), F.count_if(F.col("page") <= most).alias("regions_sent"))
    return p.join(n, "document_id", "full").na.fill(0)


def graph_invariants(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations. questions: document_id, id, source_id, parent_id."""
    lost = questions.join(nodes.select("document_id", F.col("region_id").alias("source_id")), ["document_id", "source_id"], "left_anti").select("document_id", "id", F.lit("unresolved_source").alias("violation"))
    sub = questions.where("parent_id is not null").join(side(nodes, "target", "role").withColumnRenamed("target_id", "parent_id"), ["document_id", "parent_id"], "left")
    wrong = sub.where("target_known is null or target_role <> 'QUESTION'").select("document_id", "id", F.when(F.col("target_known").isNull(), "missing_parent").otherwise("incorrect_parent"))
    linked = edges.where("relationship = 'subquestion_of'").select("document_id", "source_id", F.col("target_id").alias("parent_id"))
    unlinked = sub.join(linked, ["document_id", "source_id", "parent_id"], "left_anti").select("document_id", "id", F.lit("missing_edge"))
    return lost.union(wrong).union(unlinked)


def graph_anomalies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, what, id) of what looks wrong in a graph."""
    loops = edges.where("source_id = target_id").select("document_id", F.lit("self_loop").alias("what"), F.col("source_id").alias("id"))
    repeated = edges.groupBy("document_id", "source_id", "target_id", "relationship").count().where("count > 1").select("document_id", F.lit("duplicate_edge"), "source_id")
    parents = edges.where("relationship in ('option_of', 'subquestion_of')").groupBy("document_id", F.col("source_id").alias("region_id")).agg(F.count_distinct("target_id").alias("n"))
    kids = nodes.where("role in ('OPTION', 'SUBQUESTION')").join(parents, list(KEY), "left")
    alone = kids.where("n is null").select("document_id", F.lit("no_parent"), "region_id")
    many = kids.where("n > 1").select("document_id", F.lit("many_parents"), "region_id")
    short = nodes.where("role = 'QUESTION'").where(~has(strip(F.col("text")), r"\s")).select("document_id", F.lit("one_word_question"), "region_id")
    odd = with_ends(edges.where("relationship = 'continuation_of'"), nodes, "role").where(F.col("source_role").isin(*BOUNDARY)).select("document_id", F.lit("suspicious_continuation"), "source_id")
    return loops.union(repeated).union(alone).union(many).union(short).union(odd)


ADMIN = r"(?i)\b(?:roll no|maximum marks|time allowed|general instructions|do not write)\b"


def source_fidelity(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Violations: a text that isn't its blocks in order, no source, an administrative phrase. questions: document_id, id, text, source_ids."""
    parts = questions.select("document_id", "id", F.posexplode("source_ids").alias("ord", "region_id")).join(blocks.select(*KEY, F.col("text").alias("block")), list(KEY), "left")
    whole = parts.groupBy("document_id", "id").agg(F.array_join(ordered(strip(F.col("block")), "ord"), " ").alias("joined"))
    rows = questions.join(whole, ["document_id", "id"], "left")
    squash = lambda c: F.regexp_replace(strip(c), r"\s+", " ")
    why = F.when(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, "no_source").when(has(F.col("text"), ADMIN), "administrative_text").when(squash(F.col("text")) != squash(F.coalesce("joined", F.lit(""))), "text_differs")
    return rows.withColumn("violation", why).where("violation is not null").select("document_id", "id", "violation")


def stage_trace(nodes: DataFrame, verdicts: DataFrame, options: DataFrame) -> DataFrame:
    """What became of each region."""
    v = verdicts.select(*KEY, F.coalesce(F.concat(F.lit("rejected:"), "reason"), F.lit("question")).alias("as_question"))
    o = options.select("document_id", F.col("option_region_id").alias("region_id"), F.lit("option").alias("as_option")).distinct()
    rows = nodes.join(v, list(KEY), "left").join(o, list(KEY), "left")
    return rows.select(*KEY, "page", F.coalesce("as_question", "as_option", F.when(F.col("role") == "SECTION_HEADER", "section"), F.when(F.col("parent_region_id").isNotNull(), "continuation"), F.lit("none")).alias("disposition"))
