"""Personal data: base spans against plain Python, discovery on texts whose contexts are known, odd and long texts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quillmark.llm import pii

DIR = "/root/testdata/sf0.001"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def is_card(found):
    digits = [int(c) for c in found if c.isdigit()]
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


CHECKS = {"email": lambda f: True, "ip": lambda f: all(int(x) <= 255 for x in f.split(".")), "card": is_card, "phone": lambda f: 9 <= sum(c.isdigit() for c in f) <= 15}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if CHECKS[kind](m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def valid_card(rng, n):
    digits = [rng.randrange(1, 10) for _ in range(n - 1)]
    return next(c for c in ("".join(map(str, [*digits, last])) for last in range(10)) if is_card(c))


def test_base_spans_of_the_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op11_pii(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in PATTERNS)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))


def test_base_spans_of_odd_texts(spark):
    """Pieces of the patterns in any order: possessive runs and lookbehinds match what the plain patterns do."""
    rng = random.Random(11)
    bits = ["a", "b.c", "@", ".", "%", "+", "-", " ", "1", "22", "255", "256", "007", "x@y.z", "1.2.3.4", "+1 ", "(555)", "4111 1111-1111 1111", "é", "😀", "\n", "__", "@@", "..", "m@n.o%p@q.r", "+49", "--"]
    texts = [None, "", "\n", "1" * 19, valid_card(rng, 19), valid_card(rng, 12), "1" * 20, "00000000001.2.3.0255", "1.2.3.4.5.6.7.8", "+1" + "2" * 14, "+1" + "2" * 15, "+12345678(9", "a@b@c.d", "a@b.c@d.e"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4]), (None, texts[4])], "doc_id long, text string").repartition(4)
    rows = pii.extract(docs.withColumn("base", F.lit("own")).withColumn("mentions", F.lit(1)).withColumn("row", F.lit("r"))).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[4 if r.doc_id is None else r.doc_id]
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(text), text
        assert all(s.end <= b.start or b.end <= s.start for s in r.more for b in r.base)


def test_no_documents(spark):
    assert pii.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.extract(spark.createDataFrame([(1, None), (2, "only words here")], "doc_id long, text string")).select(F.size("more").alias("n"), F.size("base").alias("m")).distinct().collect() == [(0, 0)]


def test_long_runs_take_linear_time(spark):
    runs = ["a" * 200_000, "1" * 200_000, "1." * 100_000, "1-" * 100_000, "+1 " * 60_000, "a@" * 100_000, "+1" + " " * 200_000, "a1b2c3d4-" * 20_000, "." * 200_000, "a." * 100_000, "\n-" * 100_000]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    begin = time.time()
    rows = pii.extract(docs).collect()
    assert time.time() - begin < 120
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(runs[r.doc_id])


def test_many_matches_of_one_text(spark):
    text = "mail x1@a.b and 10.0.0.1, " * 5000
    begin = time.time()
    base = pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().base
    assert [(s.kind, s.start, s.end) for s in base] == base_spans(text)
    assert time.time() - begin < 60


def corpus():
    """Known numbers after "phone:" and before "mobile"; unknown ones after "phone:", "ext." shares unknown ones with it."""
    rng, docs = random.Random(3), []
    for i in range(12):
        docs.append(f"Reach us, phone: +1 555 010 {1000 + i} any day")
    shared = [f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}" for _ in range(6)]
    docs += [f"Home phone: {n} or so" for n in shared]
    docs += [f"dial {n} again" for n in shared]
    docs.append("dial 020-7946-0018 again")  # stands with "dial" only: found in a later round
    docs += [f"the invoice {20240000 + i} is here" for i in range(12)]  # identifiers without a known value
    docs += [f"and the total was {7000000 + i} of it" for i in range(4)] + [f"seen by the +1 555 010 {2000 + i} gate" for i in range(4)]
    docs += ["the cat and the dog went to the sea by the road " * 3] * 5  # "the" says nothing of what follows
    return docs


def more_of(spark, texts):
    rows = pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {(texts[r.doc_id][s.start : s.end], s.kind) for r in rows for s in r.more}


def test_patterns_discover_identifiers(spark):
    docs = corpus()
    numbers = {re.search(r"[0-9]+-[0-9]+-[0-9]+", d)[0] for d in docs if re.search(r"[0-9]+-[0-9]+-[0-9]+", d)}
    got = more_of(spark, docs)
    assert got == {(n, "context_phone") for n in numbers}
    assert ("020-7946-0018", "context_phone") in got


def test_one_round_does_not_reach_what_values_share(spark):
    docs = corpus()
    rows = pii.extract(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), rounds=1).collect()
    found = {docs[r.doc_id][s.start : s.end] for r in rows for s in r.more}
    assert found and "020-7946-0018" not in found


def test_copies_prove_nothing(spark):
    """One value in a thousand copies is one value: its context isn't trusted."""
    docs = ["call now +1 555 010 1000 please"] * 1000 + ["call now 555-010-1234 please"]
    assert more_of(spark, docs) == set()
