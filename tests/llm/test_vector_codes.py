"""Vector codes against k-means over all pairs, where bounds, ties and repeats decide, and on odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillmark.llm import vector_codes as V

DDL = "vec_id long, embedding array<double>, label int, code string, value string, near int"


def plain(rows, parts, entries, rounds):
    kept = [(v, [math.floor(256 * x) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [(v, [min(max(x, -V.LARGEST), V.LARGEST) for x in e], label) for v, e, label in kept if len(e) == dim]
    edges = V.edges_of(dim, parts)
    cut = lambda e: [e[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    books = list(zip(*(cut(e) for _, e, _ in kept[:entries]), strict=True))
    books = [[list(c) for c in book] for book in books]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [[min((distance(x, c), i) for i, c in enumerate(book)) for x, book in zip(cut(e), books, strict=True)] for _, e, _ in kept]

    for _ in range(rounds):
        found = nearest()
        for p, book in enumerate(books):
            for i in range(len(book)):
                own = [cut(e)[p] for (_, e, _), f in zip(kept, found, strict=True) if f[p][1] == i]
                if own:
                    book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = nearest()
    rows = [(v, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), label) for (v, _, label), f in zip(kept, found, strict=True)]
    totals = {}
    for _, _, error, label in rows:
        totals[label] = totals.get(label, 0) + error
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted(((v, c, e, totals[label]) for v, c, e, label in rows), key=repr), hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, parts, entries, rounds, closest=8):
    frame = spark.createDataFrame([(*r, "c", "v", 1) for r in rows], DDL).repartition(3)
    codes, books = V.compress(frame, parts, entries, rounds, closest)
    got = [(r.vec_id, r.code.hex(), r.error, r.label_error) for r in V.with_label_error(codes).collect()]
    return sorted(got, key=repr), V.digest(books)


def vectors(kind, n, dim, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "coarse":  # few different values: ties everywhere
        x = rng.integers(-2, 3, (n, dim)) / 8
    elif kind == "groups":
        x = rng.normal(0, 1, (8, dim))[rng.integers(0, 8, n)] + rng.normal(0, 0.05, (n, dim))
    else:
        x = rng.normal(0, 0.125, (n, dim))
    return [(i * 3 + 1, x[i].tolist(), [None, 1, 2, 3][min(3, i % 7)]) for i in range(n)]


@pytest.mark.parametrize(("kind", "parts", "entries", "rounds", "closest"), [("spread", 4, 20, 5, 8), ("coarse", 4, 16, 4, 3), ("groups", 4, 24, 6, 2), ("spread", 3, 30, 3, 1), ("coarse", 16, 64, 2, 8)])
def test_against_all_pairs(spark, kind, parts, entries, rounds, closest):
    rows = vectors(kind, 400, 16)
    assert run(spark, rows, parts, entries, rounds, closest) == plain(rows, parts, entries, rounds)


def test_odd_rows(spark):
    rows = vectors("spread", 60, 6)
    rows += [(500, None, 1), (501, [None] * 6, 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] + [0.0] * 5, 1), (504, [0.5] * 5, 1), (505, [1e300] * 6, None), (506, [-1e300] * 6, None)]
    rows += [(1, [0.0] * 6, 2), (1, [0.0] * 6, 2), (1, [0.25] * 6, None), (None, [0.1] * 6, 9)]
    assert run(spark, rows, 4, 8, 3) == plain(rows, 4, 8, 3)  # 6 components in 4 parts: 2, 2, 1, 1
    assert run(spark, rows, 9, 8, 2) == plain(rows, 9, 8, 2)  # and in 9: three are empty


def test_few_rows(spark):
    rows = vectors("spread", 3, 16)
    assert run(spark, rows, 16, 64, 2) == plain(rows, 16, 64, 2)
    assert run(spark, rows[:1], 16, 64, 2) == plain(rows[:1], 16, 64, 2)
    assert run(spark, [(1, None, 1)], 16, 64, 2) == ([], V.digest([]))


def test_bounds_save_distances():
    """Where entries hardly move, nearly all rows keep theirs without looking at others, and all are right."""
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (5000, 4))
    entries = x[:64].copy()
    state = V.all_entries(x, entries, 8)
    fresh = entries + rng.integers(-2, 3, entries.shape)
    moved = np.sqrt(((fresh - entries) ** 2).sum(1).astype(float))
    code, best, _, _, _, depth = V.assign(x, fresh, moved, 8, state[0], *state[2:])
    exact = V.distances(x, fresh)
    assert (code == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert (depth < 8).mean() > 0.95 and depth.mean() < 2


def test_states_stay_bounds():
    """Round after round, with entries that jump: no kept bound exceeds a true distance."""
    rng = random.Random(6)
    x = np.array([[rng.randrange(-50, 50) for _ in range(2)] for _ in range(800)])
    entries = x[:20].copy()
    code, _, near, lower, outer = V.all_entries(x, entries, 6)
    for b in (6, 5, 5, 3, 1):
        fresh = entries + np.array([[rng.randrange(-9, 10) if rng.random() < 0.4 else 0 for _ in range(2)] for _ in entries])
        code, best, near, lower, outer, _ = V.assign(x, fresh, np.sqrt(((fresh - entries) ** 2).sum(1).astype(float)), b, code, near, lower, outer)
        entries, exact = fresh, V.distances(x, fresh)
        assert (code == exact.argmin(1)).all() and (best == exact.min(1)).all()
        root = np.sqrt(exact)
        for i in range(len(x)):
            held = [int(e) for e in near[i] if e != 255]
            assert all(low <= root[i, e] for e, low in zip(near[i], lower[i], strict=True) if e != 255)
            rest = [root[i, e] for e in range(len(entries)) if e not in held and e != code[i]]
            assert not rest or outer[i] <= min(rest)
