"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings, in DataFrame functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base kinds, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Character classes of a candidate, first fit: (kind, all characters are of, bits of entropy that its best window needs)
CLASSES = (("entropy_hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), ("entropy_upper", r"^[A-Z0-9]+$", 3.3), ("entropy_lower", r"^[a-z0-9]+$", 3.3), ("entropy_base64", r"^[A-Za-z0-9+/_-]+$", 3.6))
#: Never a secret by entropy alone: letters or digits only, uuids, dates and paths of words.
ALLOW = r"^(?:[A-Za-z_/+-]+|[0-9_/+-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:[A-Za-z]++[/_-])++[0-9]{1,4}|(?:[0-9]{1,4}[/_-])++[A-Za-z]+)$"
KINDS = ("assign", "access", "hex", *(k for k, _, _ in CLASSES))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def matches(text: Column, pattern: str) -> Column:
    """(start, found) of the leftmost non-overlapping matches; start in code points.

    The pieces between the matches are those of a split by the same pattern, so that their lengths add up to the places:
    first for runs of as many matches as the root of their number, then inside each run, so that no list grows by copies.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("found")))
    steps = F.filter(pairs, lambda s: s["found"].isNotNull())
    total = lambda some: F.aggregate(some, F.lit(0), lambda n, s: n + s["gap"] + F.length(s["found"]))

    def placed(steps: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(steps))).cast("int")
        totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / run).cast("int")), lambda r: total(F.slice(steps, r * run + 1, run)))
        begins = bound(totals, lambda all_: F.transform(all_, lambda _, r: F.aggregate(F.slice(all_, F.lit(1), r), F.lit(0), lambda n, x: n + x)))

        def place(begins: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                r = F.floor(i / run).cast("int")
                return F.struct((F.get(begins, r) + total(F.slice(steps, r * run + 1, i - r * run)) + s["gap"]).alias("start"), s["found"].alias("found"))

            return F.transform(steps, one)

        return bound(begins, place)

    return F.when(text.rlike(pattern), bound(steps, placed)).otherwise(F.array().cast("array<struct<start: int, found: string>>"))


def spans(found: Column, kind: str | Column) -> Column:
    """Matches as spans; the rank orders kinds that start together."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), kind.alias("kind"), (m["start"] + F.length(m["found"])).alias("end")))


def window_entropy(text: Column) -> Column:
    """The highest Shannon entropy, in bits for a character, of WINDOW characters in a row.

    Counts of the characters go along the string: each step adds one and takes one away, and changes the sum of
    n * log2(n) by their difference; entropy is log2(W) - sum / W. A shorter text is one window. The string is taken apart
    once and a step looks at two places of it, so that the time is in proportion to its length.
    """
    terms = F.array(*(F.lit(0.0 if n == 0 else n * math.log2(n)) for n in range(WINDOW + 2)))
    least = F.least(F.length(text), F.lit(WINDOW))

    def bump(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda n, i: F.when(i == at, n + by).otherwise(n))

    def added(acc: Column, come: Column) -> Column:
        up = F.get(acc["counts"], come)
        return F.struct(bump(acc["counts"], come, 1).alias("counts"), (acc["sum"] + F.get(terms, up + 1) - F.get(terms, up)).alias("sum"))

    def taken(acc: Column, go: Column) -> Column:
        down = F.get(acc["counts"], go)
        return F.struct(bump(acc["counts"], go, -1).alias("counts"), (acc["sum"] + F.get(terms, down - 1) - F.get(terms, down)).alias("sum"))

    def lowest(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            come, go = F.get(codes, i - 1), F.get(codes, i - 1 - WINDOW)
            grown = bound(come, lambda c: added(acc, c))
            now = F.when(i > WINDOW, bound(grown, lambda a: bound(go, lambda c: taken(a, c)))).otherwise(grown)
            return bound(now, lambda a: F.struct(a["counts"].alias("counts"), a["sum"].alias("sum"), F.when(i >= least, F.least(acc["best"], a["sum"])).otherwise(acc["best"]).alias("best")))

        begin = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), begin, step)["best"]

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(128)))
    return F.log2(least.cast("double")) - bound(codes, lowest) / least


def entropy_spans(text: Column) -> Column:
    """Spans of candidates whose best window has the entropy that their class needs and that aren't allowed."""
    out = []
    some = F.filter(matches(text, CANDIDATE), lambda m: ~m["found"].rlike(ALLOW))
    kind_of = F.lit(None).cast("string")
    bits_of = F.lit(None).cast("double")

    def judged(m: Column) -> Column:
        kind, bits = kind_of, bits_of
        for k, pattern, least in reversed(CLASSES):
            kind = F.when(m["found"].rlike(pattern), k).otherwise(kind)
            bits = F.when(m["found"].rlike(pattern), least).otherwise(bits)
        rank = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
        return F.struct(m["start"].alias("start"), F.when(window_entropy(m["found"]) >= bits, rank).alias("rank"), kind.alias("kind"), (m["start"] + F.length(m["found"])).alias("end"))

    out = F.filter(F.transform(some, judged), lambda s: s["rank"].isNotNull())
    return F.when(F.size(some) > 0, out).otherwise(F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>"))


def joined(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, more (arrays of start, rank, kind, end) for each row of ``docs`` (doc_id, text; others are ignored).

    base has the assign, access and hex spans, in code points and end exclusive: per kind leftmost matches that don't
    overlap, without those that are too short. more has the candidates of high entropy that no base span touches. A null
    or empty text has none; repeated rows are scanned alike; overlapping kinds all stand.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {"assign": F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= LEAST["assign"])}
    found["access"] = matches(text, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")  # a failing match holds no longer one
    found["hex"] = matches(text, rf"[0-9a-f]{{{LEAST['hex']},}}")
    rows = docs.select("doc_id", F.array_sort(F.concat(*(spans(f, k) for k, f in found.items()))).alias("base"), entropy_spans(text).alias("more"))
    apart = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", apart.alias("more"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"))
