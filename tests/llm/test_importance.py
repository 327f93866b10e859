"""Importance resampling against plain Python, for single words and for runs of them, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs):
    words = re.findall(importance.WORD, (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(runs[0], runs[1] + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, runs, n_buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = [0] * n_buckets, [0] * n_buckets
    for text, counts in [(x, s) for _, x in docs] + [(x, t) for x in target]:
        for f in features(text, runs)[1]:
            counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n_buckets) / ((s[b] + 1) * (sum(t) + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for doc_id, text in docs:
        n, some = features(text, runs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in some)
        rows.append([doc_id, len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def table(n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "ÉCOLE", "it's", "a-b", "x_y", "😀", "Z9"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 21, 80])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (3, docs[3][1]), (3, docs[3][1]), (None, "same words " * 30), (None, "same words " * 30)]
    return docs, [" ".join(rng.choice(vocabulary[:40]) for _ in range(50)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("runs", [(1, 1), (1, 2), (2, 3)])
def test_against_plain_python(spark, runs):
    docs, target = table(400)
    clash = ["buckets", "weight", "row", "rank", "place", "n_words"]
    frame = spark.createDataFrame([(*d, *clash) for d in docs], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, goal, runs, 500, 20, 30, "s").collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(docs, target, runs, 500, 20, 30, "s"), key=key)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(i, "one two three " * 10) for i in range(20)], "doc_id long, text string")
    assert importance.resample(none, some.select("text")).collect() == []
    assert importance.resample(some, none.select("text")).where(F.col("rank").isNotNull()).count() == 2


def test_pieces_of_a_long_text(monkeypatch):
    """A text that is split in parts gives the features of the whole."""
    monkeypatch.setattr(importance, "PIECE", 7)
    rng = random.Random(1)
    for runs in ((1, 1), (1, 3), (2, 2), (3, 5)):
        buckets_of = importance.bucketer(runs, 1000)
        for _ in range(200):
            text = "".join(rng.choice(["a", "B", "é", "12", " ", ", ", "\n", "longerword", "😀"]) for _ in range(rng.randrange(60)))
            n, some = features(text, runs)
            got = buckets_of(text)
            assert (got[0], sorted(got[1])) == (n, sorted(zlib.crc32(f.encode()) % 1000 for f in some)), (runs, text)


def test_ranks_are_those_of_one_sort(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(5000)]
    got = importance.ranked(spark.createDataFrame(rows, "score long, doc_id long").repartition(7), [F.desc("score"), F.asc("doc_id")], "ranks").collect()
    want = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {(r.score, r.doc_id): r["rank"] for r in got} == want


def test_drawn_documents_resemble_the_target(spark):
    rng = random.Random(4)
    near, far = [f"t{i}" for i in range(50)], [f"u{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(near if i % 10 == 0 else far) for _ in range(60))) for i in range(500)], "doc_id long, text string")
    goal = spark.createDataFrame([(" ".join(rng.choice(near) for _ in range(60)),) for _ in range(20)], "text string")
    drawn = [r.doc_id for r in importance.resample(docs, goal).where(F.col("rank").isNotNull()).collect()]
    assert len(drawn) == 50 and np.mean([d % 10 == 0 for d in drawn]) == 1
