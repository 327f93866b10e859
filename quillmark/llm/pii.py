"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .secret_scan import joined, matches

# The base kinds, in order. Runs that cannot be given back are possessive, and an address begins where its
# run of characters does (or where the match before ended): the matches are the same, the time is linear.
LOCAL = r"[A-Za-z0-9._%+-]"
ADDRESS = rf"{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL = rf"(?:(?<!{LOCAL})|\G){ADDRESS}"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = (*BASE, *(f"context_{kind}" for kind in BASE))
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IS_IP = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
CARD_DIGITS = (12, 19)
PHONE_DIGITS = (9, 15)

#: What may be an identifier besides: 6 to 64 letters, digits, dots, underscores and hyphens, 4 of them digits at least.
TOKEN = r"(?<![A-Za-z0-9._-])(?=(?:[A-Za-z._-]{0,32}[0-9]){4})[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?(?![A-Za-z0-9_@-])"
#: Of adjoining addresses only the first is a mention: else each other mention would try the rest of its run for one.
MENTION = rf"(?:(?<!{LOCAL}){ADDRESS})|(?:{IP})|(?:{PHONE})|(?:{CARD})|(?:{TOKEN})"
IDENTIFIER = r"^(?=(?:[^0-9]*[0-9]){4})[A-Za-z0-9\x20._-]{6,64}$"
#: A cue is the word next to a mention, in its line, with what stands between (5 characters that are no letters at most).
WINDOW = 48
BEFORE = r"(\p{L}+)([^\p{L}\n]{0,5})$"
AFTER = r"^([^\p{L}\n]{0,5})(\p{L}+)"
WORDS = r"[^\p{L}]+"

ROUNDS = 3
LEAST_SUPPORT = 3.0  # different known values that a pattern must stand with
LEAST_SHARE = 0.2  # of a cue's occurrences anywhere, those beside a mention
TRUST = 0.5  # confidence from which a pattern names what stands with it
DOUBT = 1.0  # added to the number of a pattern's values, so that few of them prove less
MOST = 0.99  # confidence that no pattern exceeds, so that instances stay comparable


def digits(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", ""))


def luhn(found: Column) -> Column:
    """Whether the digits of ``found`` pass the check: from the right, every second one doubled, its digits added."""
    plain = F.regexp_replace(found, "[^0-9]", "")
    size = F.length(plain)

    def worth(i: Column) -> Column:
        digit = F.substring(plain, i, F.lit(1)).cast("int")
        double = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when((size - i) % 2 == 1, double).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda n, i: n + worth(i))
    return F.when(size.between(*CARD_DIGITS), total % 10 == 0).otherwise(False)


def holds(kind: str, found: Column) -> Column:
    """Whether a match of a kind's pattern is one of that kind."""
    return {"email": F.lit(True), "ip": found.rlike(IS_IP), "card": luhn(found), "phone": digits(found).between(*PHONE_DIGITS)}[kind]


def kind_of(found: Column) -> Column:
    """The base kind that a whole mention is of; null: none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(BASE.items()):
        out = F.when(F.when(found.rlike(f"^(?:{pattern})$"), holds(kind, found)).otherwise(False), kind).otherwise(out)
    return out


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def spans_of(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda m: holds(kind, m["found"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), rank(F.lit(kind)).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["found"])).alias("end")))


def base_spans(text: Column) -> Column:
    """start, rank, kind, end of the base spans, in code points, by start and kind."""
    return F.array_sort(F.concat(*(spans_of(text, kind) for kind in BASE)))


def mentions(text: Column) -> Column:
    """start, end, value, kind (null: not known) and the patterns of each mention: what may identify someone, with the cues
    to its left and right."""
    gaps = F.split(text, MENTION, -1)
    tail = F.transform(gaps, lambda g: F.right(g, F.lit(WINDOW)))
    head = F.slice(F.transform(gaps, lambda g: F.left(g, F.lit(WINDOW))), F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    beside = F.zip_with(tail, head, lambda before, after: F.struct(before.alias("before"), after.alias("after")))

    def seen(m: Column, c: Column) -> Column:
        cue = F.lower(F.regexp_extract(c["before"], BEFORE, 1))
        left = F.when(cue != "", F.concat(F.lit("<"), cue, F.lit("|"), F.trim(F.regexp_extract(c["before"], BEFORE, 2))))
        cue = F.lower(F.regexp_extract(c["after"], AFTER, 2))
        right = F.when(cue != "", F.concat(F.lit(">"), cue, F.lit("|"), F.trim(F.regexp_extract(c["after"], AFTER, 1))))
        found = m["found"]
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(found)).alias("end"), F.lower(found).alias("value"), kind_of(found).alias("kind"), F.array_compact(F.array(left, right)).alias("patterns"))

    # What isn't an identifier at all goes before it is looked at closely.
    pairs = F.filter(F.zip_with(matches(text, MENTION), beside, lambda m, c: F.struct(m.alias("m"), c.alias("c"))), lambda p: p["m"].isNotNull() & (p["m"]["found"].contains("@") | p["m"]["found"].contains("+") | p["m"]["found"].rlike(IDENTIFIER)))
    some = F.filter(F.transform(pairs, lambda p: seen(p["m"], p["c"])), lambda s: s["kind"].isNotNull() | s["value"].rlike(IDENTIFIER))
    return F.when(text.rlike(MENTION), some).otherwise(F.array().cast("array<struct<start: int, end: int, value: string, kind: string, patterns: array<string>>>"))


def cue_of(pattern: Column) -> Column:
    return F.split_part(F.substring(pattern, F.lit(2), F.length(pattern)), F.lit("|"), F.lit(1))


def edges_of(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, value, kind: which patterns stand with which values, each pair once however often it occurs.

    Only patterns are kept that can be trusted at all: they have as many values as LEAST_SUPPORT, and their cue stands
    beside mentions in LEAST_SHARE of its occurrences in all texts. Words are counted where they are read, then summed.
    """
    found = scanned.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.value", "m.kind")
    pairs = materialize(found.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "pairs")
    patterns = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n"))
    side = [F.substring("pattern", 1, 1).alias("side"), cue_of(F.col("pattern")).alias("cue")]
    beside = patterns.groupBy(*side).agg(F.sum("n").alias("beside"), F.max("n_values").alias("most")).where(F.col("most") >= LEAST_SUPPORT)
    words = docs.select(F.explode(F.split(F.lower("text"), WORDS, -1)).alias("cue")).where("cue <> ''").groupBy("cue").agg(F.count(F.lit(1)).alias("times"))
    cues = beside.join(words, "cue").where(F.col("beside") >= LEAST_SHARE * F.col("times")).select("side", "cue")
    good = patterns.where(F.col("n_values") >= LEAST_SUPPORT).select("pattern", *side).join(cues, ["side", "cue"]).select("pattern")
    return materialize(pairs.join(good, "pattern").select("pattern", "value", "kind"), "edges")


def best_kind(weight: str) -> Column:
    """The kind of the highest weight, ties to the kind listed first."""
    return F.max_by(F.struct("kind", weight), F.struct(F.col(weight), -rank(F.col("kind")))).alias("best")


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence of the patterns that can be trusted, by rounds over the graph of patterns and values.

    Values of known kind count 1 for it. A pattern's confidence in a kind is the sum of its values' scores over the number
    of all its values and DOUBT; those that reach TRUST with a sum of LEAST_SUPPORT score their unknown values: one less the
    product of what is left of each confidence. The next round takes these scores into the sums, so that a pattern without
    known values can be trusted for the values it shares with others.
    """
    spark = edges.sparkSession
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = edges.where("kind is not null").select("pattern", "kind", F.lit(1.0).alias("score"))
    scored, trusted = known, None
    for i in range(rounds):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).groupBy("pattern").agg(best_kind("sum"))
        judged = sums.join(sizes, "pattern").select("pattern", "best.kind", "best.sum", F.least(F.col("best.sum") / (F.col("n") + DOUBT), F.lit(MOST)).alias("confidence"))
        trusted = materialize(judged.where((F.col("sum") >= LEAST_SUPPORT) & (F.col("confidence") >= TRUST)).select("pattern", "kind", "confidence"), "trusted")
        if i == rounds - 1 or trusted.isEmpty():
            break
        unknown = edges.where("kind is null").select("pattern", "value")
        left = unknown.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        scores = left.groupBy("value").agg(best_kind("score")).select("value", "best.kind", "best.score")
        scored = known.union(unknown.join(scores, "value").select("pattern", "kind", "score"))
    return trusted if trusted is not None else spark.createDataFrame([], "pattern string, kind string, confidence double")


def found_by(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """row, more: the unknown mentions (start, rank, kind, end) that stand with trusted patterns, as kind context_<kind>."""
    open_ = scanned.select("row", F.explode(F.filter("mentions", lambda m: m["kind"].isNull())).alias("m")).select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    hits = open_.join(trusted, "pattern").groupBy("row", "start", "end").agg(best_kind("confidence")).withColumn("kind", F.concat(F.lit("context_"), F.col("best.kind")))
    return hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank(F.col("kind")).alias("rank"), "kind", "end"))).alias("more"))


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base, more (arrays of start, rank, kind, end) for each row of ``docs`` (doc_id, text; others are ignored).

    base has the email, ip, card and phone spans, in code points and end exclusive: per kind leftmost matches that don't
    overlap, without those that fail its check. more has the identifiers that are none of these but stand in contexts which
    the base spans of all texts have made trustworthy (``trusted_patterns``), and that no base span touches. A null or empty
    text has none; repeated rows have the same spans, and copies of a text add nothing to a pattern's confidence, as values
    count once; overlapping base kinds all stand. An empty table gives no row.

    Texts are scanned once for spans and mentions and once for the counts of words; what the rounds work on is the mentions,
    written to the shared folder. Rows meet their finds by a number that only one row has.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", base_spans(text).alias("base"), mentions(text).alias("mentions"))
    scanned = materialize(scanned, "mentions")
    more = found_by(scanned, trusted_patterns(edges_of(scanned, docs), rounds))
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>")
    rows = scanned.select("row", "doc_id", "base").join(more, "row", "left").withColumn("more", F.coalesce("more", none))
    apart = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", apart.alias("more"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"))
