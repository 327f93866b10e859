"""Document regions: cleaning, classification, reading order, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import has, once, strip

# The patterns of the region classifier and guards.
NUMBERED = r"(?i)^(?:Q(?:uestion)?[\s.\\:]*)?\d+[.):\s]+"
PART = r"^\s*[(\[]\s*(?:[ivxlcdm]{1,5}|[a-z]{1,2})\s*[)\]][.:\s]+"
ROMAN_PART = r"(?i)^\s*[(\[]\s*[ivxlcdm]{1,5}\s*[)\]][.:\s]+"
ASKING = r"(?i)\b(what|which|why|how|explain|describe|calculate|evaluate|find|prove|derive|compare|define|list|state|discuss|show|write|determine|solve|select|choose|identify|mark|indicate)\b"
OPTION = r"(?i)^\s*(?:[(\[]\s*[A-E1-4]\s*[)\]]|[A-Ea-e1-4]\s*[.:])(?:\s+|$)|^(?:Option|Choice)\s+[(]?[A-Za-z0-9ivxlcdm]+\)?[.:\s]*"
INSTRUCTION = r"(?i)\b(?:Note|Instructions|General Instructions|Notice|Read carefully|Answer all|All questions carry|COMPULSORY|carrying \w+ marks|attempt any \w+ questions)\b"
SECTION = r"(?i)^\s*(?:SECTION|PART|GROUP|UNIT|CHAPTER)\s*[\-–\s]*[A-Z0-9IVX]+(?:\s*[:\-]\s*.*)?$"
PREFIXED = r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?\d{1,3}\s*[.):\-]|^[(\[]?[A-Da-d1-9i-zIVXLCDM]+[)\].:]\s*"
FIGURE = r"(?i)\[(?:Diagram|Figure|Image|Graph)\]|\b(?:Fig\.|Figure|Diagram)\s*\d+"
METADATA = r"(?i)\b(?:Roll No|Name|Date|Subject|Time Allowed|Maximum Marks|Class|Session)\b"
MARKER = r"(?i)^\s*[(\[]?\s*(?:i{1,4}v?|vi{0,3}|ix|x|[a-d]|[ivxlcdm]{1,4})\s*[)\].:]?\s*$"
BARE = r"(?i)^\s*(?:Q\.?)?\d{1,3}\.?\s*$"
INTRO = r"(?i)\b(?:write\s+briefly|answer\s+the\s+following|attempt\s+any|short\s+answer\s+(?:questions?)?|attempt\s+the\s+following|answer\s+any|describe\s+briefly|explain\s+briefly|give\s+(?:short\s+)?(?:answers?|notes?))\b"
BARE_OPTION = r"^\s*[(\[]?\s*[A-Da-d1-4]\s*[)\].:]?\s*$"
STRUCTURAL = ("QUESTION", "OPTION", "SECTION_HEADER", "HEADER", "FOOTER")
BAND = 200.0  # pixels of a y-band, for joins of boxes


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_garbled(c: Column) -> Column:
    """Blank, or six letters or more that are under .4 of the text or without a vowel."""

    def judged(r: Column) -> Column:
        n = F.length(r["letters"])
        return (r["t"] == "") | ((n >= 6) & ((n / F.greatest(F.length(r["t"]), F.lit(1)) < 0.4) | ~has(r["letters"], "(?i)[aeiou]")))

    return once(strip(F.coalesce(c, F.lit(""))), lambda t: once(F.struct(t.alias("t"), F.regexp_replace(t, r"[^\p{L}]+", "").alias("letters")), judged))


def token_jaccard(a: Column, b: Column) -> Column:
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))

    def shared(r: Column) -> Column:
        whole = F.size(r["a"]) + F.size(r["b"])
        return F.when((F.size(r["a"]) == 0) | (F.size(r["b"]) == 0), 0.0).otherwise(once(F.size(F.array_intersect(r["a"], r["b"])), lambda n: n / (whole - n)))

    return once(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), shared)


def choose_text_source(ocr: Column, model: Column) -> Column:
    """struct(text, source): the character-exact reading unless it is empty, garbled or far from a model's."""

    def chosen(r: Column) -> Column:
        o, m = r["o"], r["m"]
        out = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
        return F.when(m == "", out(o, "OCR")).when(o == "", out(m, "VLM_FALLBACK_EMPTY_OCR")).when(is_garbled(o) & ~is_garbled(m), out(m, "VLM_FALLBACK_GARBLED_OCR")).when((F.length(m) >= 3) & (token_jaccard(o, m) < 0.25), out(m, "VLM_OVERRIDE_LOW_AGREEMENT")).otherwise(out(o, "OCR"))

    return once(F.struct(strip(F.coalesce(ocr, F.lit(""))).alias("o"), strip(F.coalesce(model, F.lit(""))).alias("m")), chosen)


def classify_region(text: Column, y: Column, height: Column, page_height: Column, visual: Column | None = None) -> Column:
    """array of struct(type, confidence, source): what the text, the place and header terms say of a region, in this order."""
    h = lambda kind, conf, source: F.struct(F.lit(kind).alias("type"), F.lit(conf).alias("confidence"), F.lit(source).alias("source"))
    p = lambda kind, conf: h(kind, conf, "parser")
    place = lambda kind, conf: h(kind, conf, "layout_analyzer")
    top, bottom = F.when(page_height > 0, y / page_height).otherwise(0.0), F.when(page_height > 0, (y + height) / page_height).otherwise(0.0)

    def said(t: Column) -> Column:
        parser = (F.when(has(t, INSTRUCTION), p("INSTRUCTION", 0.90)).when(has(t, SECTION), p("SECTION_HEADER", 0.95)).when(has(t, NUMBERED), F.when(has(t, ASKING), p("QUESTION", 0.92)).otherwise(p("QUESTION", 0.80)))
                  .when(has(t, PART) | has(t, ROMAN_PART), p("SUBQUESTION", 0.82)).when(has(t, OPTION), p("OPTION", 0.88)))
        shown = has(t, FIGURE) | (F.coalesce(visual, F.lit(False)) if visual is not None else F.lit(False))
        tabular = has(t, r"(?m)^\|.*?\|") | has(t, r"(?i)\bTable\s*\d*[:.\s]") | (F.length(t) - F.length(F.replace(t, F.lit("\t"))) >= 2)
        layout = (F.when(shown, place("DIAGRAM", 0.90)).when(tabular, place("TABLE", 0.88)).when((top < 0.06) & ~has(t, r"[.?!]$") & ~has(t, PREFIXED), place("HEADER", 0.85)).when(bottom > 0.94, place("FOOTER", 0.85)))
        more = F.when(has(t, METADATA), h("METADATA", 0.90, "semantic_analyzer"))
        return once(parser, lambda own: F.array(own, F.when(~F.coalesce(own["type"].isin("QUESTION", "SUBQUESTION", "OPTION"), F.lit(False)), layout), more))

    return F.array_compact(once(strip(text), said))


def resolve_hypotheses(hypotheses: Column) -> Column:
    """struct(type, confidence, conflict, uncertainty): the most confident, the first of equals; less sure when types differ."""
    ranked = F.array_sort(F.transform(hypotheses, lambda x, i: F.struct((-x["confidence"]).alias("order"), i.alias("i"), x["type"].alias("type"), x["confidence"].alias("confidence"))))
    top, differ = F.get(ranked, F.lit(0)), F.size(F.array_distinct(F.transform(hypotheses, lambda x: x["type"]))) > 1
    kind, conf = F.coalesce(top["type"], F.lit("UNKNOWN")), F.coalesce(F.when(differ, top["confidence"] * 0.85).otherwise(top["confidence"]), F.lit(0.5))
    return F.struct(kind.alias("type"), conf.alias("confidence"), differ.alias("conflict"), F.when(differ, 0.4).when(top.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - top["confidence"])).alias("uncertainty"))


def is_fragment(text: Column) -> Column:
    return (has(text, MARKER) & (F.length(strip(text)) <= 8)) | has(text, BARE)


def is_group_parent(text: Column) -> Column:
    """An intro that isn't answerable itself: it ends with a colon, or is short and only asks to answer what follows."""
    body = strip(F.regexp_replace(text, r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?\d{1,3}\s*[.):–-]?\s*", ""))
    return has(strip(text), ":$") | (has(body, INTRO) & (F.length(body) < 80))


def display_number(text: Column, parent: Column | None = None, index: Column | None = None) -> Column:
    t = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?i)^[a-f0-9]{4,8}\s+(?=.*[A-Za-z0-9])", "")
    pick = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    sub = r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?[(\[]?(\d{1,3})[)\]]?\s*[.:\-]?\s*[(\[]?\s*([a-z]{1,2})\s*[)\].:]"
    letter = pick(r"(?i)^\s*[(\[]?\s*([a-z]{1,2})\s*[)\].:]")
    parent = F.lit("1") if parent is None else parent
    return F.coalesce(F.when(has(t, sub), F.concat(pick(sub), F.lit("("), F.lower(pick(sub, 2)), F.lit(")"))), F.concat(parent, F.lit("("), F.lower(letter), F.lit(")")), pick(r"(?i)^\s*(?:Q(?:uestion)?\.?\s*|Ans(?:wer)?\.?\s*)?[(\[]?\s*(\d{1,3})\s*[)\].:\-]"), pick(r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?[(\[]?\s*(\d{1,3})\b"), index.cast("string") if index is not None else parent)


def answer_anchor(text: Column) -> Column:
    """Q1 of 'Q1. (D) x', where the bracket is a choice, but Q1(a) of 'Q1(a) x'."""
    t = strip(text)
    number, part = F.regexp_extract(t, r"(?i)^Q?\s*(\d{1,3})", 1), F.regexp_extract(t, r"(?i)^Q?\s*\d{1,3}\s*\(([a-z])\)", 1)
    return F.when(number == "", None).when((part != "") & ~has(t, r"(?i)^Q?\s*\d{1,3}\s*\.\s+\("), F.concat(F.lit("Q"), number, F.lit("("), F.lower(part), F.lit(")"))).otherwise(F.concat(F.lit("Q"), number))


def verification_targets(regions: DataFrame, least: float = 0.80) -> DataFrame:
    return regions.where(F.col("classification_conflict") | (F.col("confidence") < least))


def targets_skipped(regions: DataFrame, least: float = 0.80) -> DataFrame:
    sent = F.col("classification_conflict") | (F.col("confidence") < least)
    return regions.groupBy("document_id").agg(F.count("*").alias("regions"), F.count_if(sent).alias("sent"), F.count_if(~sent).alias("skipped"))


def region_conflicts(regions: DataFrame) -> DataFrame:
    return regions.where("classification_conflict").select("document_id", "region_id", F.array_sort(F.transform("hypotheses", lambda h: F.concat(h["source"], F.lit(":"), h["type"]))).alias("competing"))


PAGE = ("document_id", "page")


def reading_order(regions: DataFrame) -> DataFrame:
    """follows edges: each region follows the one before it by (y, x)."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "region_id")
    return regions.withColumn("target_id", F.lag("region_id").over(w)).where("target_id is not null").select("document_id", "page", F.col("region_id").alias("source_id"), "target_id", F.lit("follows").alias("relationship"), F.lit(0.95).alias("confidence"))


def reading_columns(regions: DataFrame, page_width: Column) -> DataFrame:
    """Column 0 or 1: two where a page has two narrow regions or more on either side; order_in_page by (column, y, x)."""
    centre, narrow = F.col("x") + F.col("width") / 2, F.col("width") < page_width * 0.6
    w = Window.partitionBy(*PAGE)
    two = (F.count_if(narrow & (centre < page_width / 2)).over(w) >= 2) & (F.count_if(narrow & (centre >= page_width / 2)).over(w) >= 2)
    rows = regions.withColumn("column", F.when(two & (centre >= page_width / 2), 1).otherwise(0))
    return rows.withColumn("order_in_page", F.row_number().over(w.orderBy("column", "y", "x", "region_id")))


def dedupe_by_number(regions: DataFrame) -> DataFrame:
    """The most confident of each number of a document, the first of equals. A null number is never a repeat."""
    w = Window.partitionBy("document_id", "number").orderBy(F.desc("confidence"), "page", "y", "x", "region_id")
    return regions.withColumn("r", F.row_number().over(w)).where("r = 1 or number is null").drop("r")


def dedupe_by_position(regions: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE, F.rint(F.col("y") / 5)).orderBy("y", "x", "region_id")
    return regions.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def page_neighbour_context(regions: DataFrame) -> DataFrame:
    """First five texts of the previous and the next page, joined by a bar, 200 characters."""
    packed = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x", "region_id", "text"))).alias("t"))
    text = packed.select(*PAGE, F.substring(F.array_join(F.transform(F.slice("t", 1, 5), lambda r: r["text"]), " | "), 1, 200).alias("summary"))
    side = lambda by, name: text.select("document_id", (F.col("page") + by).alias("page"), F.col("summary").alias(name))
    return text.select(*PAGE).join(side(1, "prev_page_summary"), list(PAGE), "left").join(side(-1, "next_page_summary"), list(PAGE), "left")


def page_cap(pages: DataFrame, most: int = 6) -> DataFrame:
    return pages.where(F.col("page") <= most)


def page_groups(pages: DataFrame, most: int = 40) -> DataFrame:
    """Pages of a document beyond ``most`` are joined into groups of ceil(n / most)."""
    n = F.max("page").over(Window.partitionBy("document_id"))
    return pages.withColumn("page_group", F.floor((F.col("page") - 1) / F.ceil(n / most)))


def union_bbox(regions: DataFrame, *keys: str, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """The hull of the boxes of each group, one decimal; padded for a viewer."""
    hull = regions.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    one = lambda c: F.bround(c, 1)
    return hull.select(*keys, one(F.greatest(F.lit(0.0), F.col("x0") - pad_x)).alias("x"), one(F.greatest(F.lit(0.0), F.col("y0") - pad_y)).alias("y"), one(F.col("x1") - F.col("x0") + 2 * pad_x).alias("width"), one(F.col("y1") - F.col("y0") + 2 * pad_y).alias("height"))


def bands(y0: Column, y1: Column) -> Column:
    return F.sequence(F.floor(y0 / BAND).cast("int"), F.floor(F.greatest(y0, y1) / BAND).cast("int"))


def box_scores(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """How well each text region fits each visual box of its page: document_id, page, box_id, region_id, text, y, x, score.

    boxes: document_id, page, box_id, x, y, width, height. Boxes and regions meet in y-bands (an equi-join; a crowded page
    is spread over its bands), each pair once; pairs that fit too badly are left out.
    """
    b = boxes.select("document_id", "page", "box_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("width").alias("bw"), F.col("height").alias("bh"))
    b = b.withColumn("band", F.explode(bands(F.col("by") - 15, F.col("by") + F.col("bh") + 15)))
    r = regions.select("document_id", "page", "region_id", "text", "x", "y", "width", "height").withColumn("band", F.explode(bands(F.col("y"), F.col("y") + F.col("height"))))
    near = b.join(r, ["document_id", "page", "band"]).dropDuplicates(["document_id", "page", "box_id", "region_id"])
    over = lambda a, aw, c, cw: F.greatest(F.lit(0.0), F.least(F.col(a) + F.col(aw), F.col(c) + F.col(cw)) - F.greatest(F.col(a), F.col(c)))
    ox, oy = over("bx", "bw", "x", "width"), over("by", "bh", "y", "height")
    area = lambda w, h: F.greatest(F.lit(1.0), F.greatest(F.lit(0.0), F.col(w)) * F.greatest(F.lit(0.0), F.col(h)))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = cx.between(F.col("bx") - 15, F.col("bx") + F.col("bw") + 15) & cy.between(F.col("by") - 15, F.col("by") + F.col("bh") + 15)
    held = (F.col("x") >= F.col("bx") - 5) & (F.col("y") >= F.col("by") - 5) & (F.col("x") + F.col("width") <= F.col("bx") + F.col("bw") + 5) & (F.col("y") + F.col("height") <= F.col("by") + F.col("bh") + 5)
    cap = lambda most, v: F.least(F.lit(most), v)
    score = F.when(held, 0.70).when(inside, 0.50).otherwise(0.0) + cap(0.50, ox * oy / area("bw", "bh") * 2.25) + cap(0.40, ox * oy / area("width", "height") * 1.4) + cap(0.35, oy / F.greatest(F.lit(1.0), F.greatest("bh", "height")) * 1.25) + cap(0.25, ox / F.greatest(F.lit(1.0), F.greatest("bw", "width")))
    return near.where((ox * oy > 0) | inside).select("document_id", "page", "box_id", "region_id", "text", "y", "x", score.alias("score")).where("score >= 0.15")


def ground_boxes(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Text regions of each visual box of a page (as of ``box_scores``), with a status and their text."""
    w = Window.partitionBy("document_id", "page", "box_id")
    scored = box_scores(boxes, regions).withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.greatest(F.lit(0.2), F.col("top") * 0.5))
    kept = scored.groupBy("document_id", "page", "box_id").agg(F.max("top").alias("top"), F.array_sort(F.collect_list(F.struct("y", "x", "region_id", strip(F.col("text")).alias("text")))).alias("kept"))
    out = boxes.select("document_id", "page", "box_id").join(kept, ["document_id", "page", "box_id"], "left")
    n = F.coalesce(F.size("kept"), F.lit(0))
    status = F.when(n <= 0, "UNGROUNDED").when(((n == 1) & (F.col("top") < 0.30)) | ((n > 1) & (F.col("top") < 0.40)), "PARTIALLY_GROUNDED").otherwise("GROUNDED")
    words = F.filter(F.transform("kept", lambda k: k["text"]), lambda t: t != "")
    return out.select("document_id", "page", "box_id", F.coalesce(F.transform("kept", lambda k: k["region_id"]), F.array().cast("array<string>")).alias("region_ids"), status.alias("status"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("text"))


def nearest_preceding_parent(regions: DataFrame, child: str = "OPTION", parent: str = "QUESTION") -> DataFrame:
    """option_of edges: the last question above each option, in (y, x) on its page."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "region_id").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("region_type") == parent, F.col("region_id")), ignorenulls=True).over(w)
    return regions.withColumn("target_id", above).where((F.col("region_type") == child) & F.col("target_id").isNotNull()).select(*PAGE, F.col("region_id").alias("source_id"), "target_id", F.lit(f"{child.lower()}_of").alias("relationship"), F.lit(0.90).alias("confidence"))


def same_row_body(regions: DataFrame, most: int = 2) -> DataFrame:
    """For options that are only a label, the text of up to two regions to their right in the same row."""
    label = regions.where((F.col("region_type") == "OPTION") & has(F.col("text"), BARE_OPTION)).select(*PAGE, F.col("region_id").alias("option_id"), F.col("y").alias("oy"), (F.col("x") + F.col("width")).alias("right"), F.greatest(F.col("height"), F.lit(12.0)).alias("tall"))
    label = label.withColumn("band", F.explode(bands(F.col("oy") - F.col("tall") * 1.2, F.col("oy") + F.col("tall") * 1.2)))
    body = regions.where(~F.col("region_type").isin(*STRUCTURAL) & (strip(F.col("text")) != "")).select(*PAGE, "region_id", "x", "y", "text", F.floor(F.col("y") / BAND).cast("int").alias("band"))
    row = label.join(body, [*PAGE, "band"]).where((F.abs(F.col("y") - F.col("oy")) <= F.col("tall") * 1.2) & F.col("x").between(F.col("right") - 5, F.col("right") + 300) & (F.col("region_id") != F.col("option_id")))
    w = Window.partitionBy(*PAGE, "option_id").orderBy("x", "region_id")
    first = row.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return first.groupBy(*PAGE, "option_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", strip(F.col("text")).alias("text")))), lambda t: t["text"]), " ").alias("body"))


def section_membership(regions: DataFrame, whole_document: bool = False) -> DataFrame:
    """section_member edges: the last section header above each region, on its page or in its document."""
    header = (F.col("region_type") == "SECTION_HEADER") | has(F.col("text"), r"(?i)^\s*(?:SECTION|PART|GROUP)\s+[A-Z0-9]")
    w = Window.partitionBy("document_id") if whole_document else Window.partitionBy(*PAGE)
    order = (["page"] if whole_document else []) + ["y", "x", "region_id"]
    above = F.last(F.when(header, F.col("region_id")), ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return regions.withColumn("section_id", above).where(~header & F.col("section_id").isNotNull()).select(*PAGE, F.col("section_id").alias("source_id"), F.col("region_id").alias("target_id"), F.lit("section_member").alias("relationship"), F.lit(0.95).alias("confidence"))


def cross_page_continuation(regions: DataFrame) -> DataFrame:
    """The first region of a page continues the last question (else region) of the page before, unless it has a role of its own."""
    packed = regions.groupBy(*PAGE).agg(F.min_by(F.struct("region_id", "text", "region_type"), "ord").alias("first"), F.max_by(F.struct("region_id", "text"), "ord").alias("last"), F.max_by(F.when(F.col("region_type") == "QUESTION", F.struct("region_id", "text")), F.when(F.col("region_type") == "QUESTION", F.col("ord"))).alias("question"))
    w = Window.partitionBy("document_id").orderBy("page")
    pages = packed.withColumn("from", F.coalesce("question", "last")).withColumn("next", F.lead("first").over(w)).where("next is not null")
    free = ~F.col("next.region_type").isin("QUESTION", "OPTION", "SUBQUESTION", "SECTION_HEADER", "INSTRUCTION", "HEADER", "FOOTER", "METADATA")
    text = strip(F.col("from.text"))
    goes_on = (text != "") & (~has(text, r"[.?!:;]$") | ~has(strip(F.col("next.text")), r"(?i)^\s*(?:SECTION|PART|Q\d+|\d+\.)"))
    return pages.where(free & goes_on).select("document_id", F.col("next.region_id").alias("source_id"), F.col("from.region_id").alias("target_id"), F.lit("continuation_of").alias("relationship"), F.lit(0.85).alias("confidence"))
