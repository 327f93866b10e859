"""Registered queries against plain Python over whole tables."""

import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import hashing, secret_scan, url_filter

DIR = "/root/testdata/sf0.001"
PATTERNS = {
    "assign": re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m[m.re.groups]) >= LEAST[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_secret_scan_base(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = secret_scan.op6_secret_scan(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in PATTERNS)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_secret_scan_odd_texts(spark):
    key = "0123456789abcdef" * 2
    texts = [None, "", "é😀 token = 'abcdefgh' " + key, "secret: short", "API_KEY=\"A.b-c_d=\"", "password=password=12345678", "ſecret=abcdefgh1", f"AKIA{'Z' * 11}", f"AKIA{'Z' * 12}9", key + "g" + key, f"x {key}\r\n{key}\x85{key}"]
    texts += [f" {key}" * n for n in (1, 2, 3, 4, 5, 10, 17)]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string")
    rows = secret_scan.scan(docs.withColumn("base", F.lit("own"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(texts[r.doc_id])
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secret_scan_many_matches(spark):
    """Time in proportion, about, to the matches of one text."""
    text = (" " + "0123456789abcdef" * 2) * 16_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    base = secret_scan.scan(docs).select("base").first().base
    assert [(s.kind, s.start, s.end) for s in base] == base_spans(text)
    assert time.time() - begin < 60


def test_url_parts_and_rules(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url").collect()}
    got = url_filter.op8_url_filter(spark, DIR).collect()
    assert len(got) == len(urls)
    for r in got:
        head, sep, rest = (urls[r.page_id] or "").partition("://")
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if sep else ("", "")
        fit = [x for x in rules if ("." + host).endswith("." + x.partition("/")[0]) and path.startswith("/" + x.partition("/")[2])]
        rule = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")


def test_runs_of_buckets():
    """What occurs is walked, not all buckets."""
    rng = np.random.default_rng(5)
    for size, n in ((0, 7), (1, 3), (5000, 11), (5000, 1 << 40)):
        bucket = np.sort(rng.integers(0, n, size))
        runs = hashing.runs_of(bucket)
        assert [b for b, _, _ in runs] == sorted(set(bucket.tolist()))
        assert all((bucket[x:y] == b).all() for b, x, y in runs) and sum(y - x for _, x, y in runs) == size


def plain_entropy(text):
    best = 0.0
    for i in range(max(1, len(text) - secret_scan.WINDOW + 1)):
        part = text[i : i + secret_scan.WINDOW]
        best = max(best, -sum(part.count(c) / len(part) * np.log2(part.count(c) / len(part)) for c in set(part)))
    return best


def test_window_entropy(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(some), n)) for some in ("ab", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/_-") for n in (1, 2, 19, 20, 21, 22, 60, 400)]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.e for r in docs.select("t", secret_scan.window_entropy(F.col("t")).alias("e")).collect()}
    assert all(abs(got[t] - plain_entropy(t)) < 1e-9 for t in texts)


def test_secret_scan_long_candidates(spark):
    """One candidate of 100,000 characters of each kind: time in proportion, one span or none, as for short ones."""
    rng = np.random.default_rng(4)
    base64, path = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 100_000)), "ab/" * 33_000 + "12"
    docs = spark.createDataFrame([(1, base64), (2, path), (3, "12/" * 33_000 + "ab"), (4, "x " + base64[:50_000] + " y")], "doc_id long, text string").repartition(4)
    begin = time.time()
    more = {r.doc_id: [(s.kind, s.start, s.end) for s in r.more] for r in secret_scan.scan(docs).collect()}
    assert time.time() - begin < 90
    assert more == {1: [("entropy_base64", 0, 100_000)], 2: [], 3: [], 4: [("entropy_base64", 2, 50_002)]}
