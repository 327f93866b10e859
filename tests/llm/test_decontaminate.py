"""op3 against all alignments of every item with every text, and against planted places."""

import random

import pyarrow as pa

from quillmark.llm import decontaminate as D


def normalised(text):
    return b" ".join(text.encode().lower().split())


def budget(m):
    """The edits that the operator allows an item of m bytes."""
    return int(min(D.EDITS * m, 0.75 * max(m - D.Q + 1, 0) / D.Q))


def fewest_edits(item, text):
    """Of an item against any part of a text: one column of the full alignment for each of its bytes."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        diagonal, column[0] = column[0], 0
        for i, x in enumerate(item, 1):
            diagonal, column[i] = column[i], min(diagonal + (x != c), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("xyz")
        elif kind == 1:
            text.insert(at, rng.choice("xyz"))
        else:
            del text[at]
    return "".join(text)


def prose(rng, n):
    words = ["river", "stone", "bridge", "a", "of", "morning", "carries", "the", "élan", "gate", "seven"]
    return " ".join(rng.choice(words) for _ in range(n))


def test_against_all_alignments(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([2, 4, 9, 15, 30]))) for i in range(12)] + [(50, "short"), (51, ""), (52, None)]
    rows, n = [], 0
    for i, item in items[:12]:
        for off in (-2, -1, 0, 1, 2, 4):
            k = max(0, budget(len(normalised(item))) + off)
            rows.append((n, f"{prose(rng, rng.randrange(25))} {edited(rng, item, k)} {prose(rng, rng.randrange(25))}"))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, prose(rng, 60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    sound = [(i, normalised(t)) for i, t in items if t is not None and len(normalised(t)) >= D.Q]
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        own = normalised(text or "")
        want = {i: fewest_edits(t, own) for i, t in sound}
        want = {i: e for i, e in want.items() if e <= budget(len(dict(sound)[i]))}
        assert got[doc_id].item_ids == sorted(want), (doc_id, text)
        assert got[doc_id].contaminated == bool(want) and got[doc_id].n_regions == len(got[doc_id].regions)
        best = {}
        for r in got[doc_id].regions:
            best[r.item_id] = min(r.edits, best.get(r.item_id, r.edits))
        assert best == want
        some += bool(want)
    assert 20 < some < len(rows)


def test_each_place_is_one_region(spark):
    """Copies that follow each other at any distance are told apart, and none is counted twice."""
    rng = random.Random(6)
    item = "measure the width of the old canal before you draw its second lock"
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = []
    for n in range(40):
        gap = "q" * n
        rows.append((n, "z" * rng.randrange(90) + item[1:] + gap + " " + item.upper() + gap + edited(rng, item, 2)))
    got = D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    texts = dict(rows)
    for r in got:
        assert r.n_regions == 3, (r.doc_id, r.regions)
        first, second, third = r.regions
        assert texts[r.doc_id][second.start : second.end] == item.upper() and second.edits == 0
        assert first.start < second.start < third.start


def test_short_copies_side_by_side():
    """Copies that lost some of their letters end less than an item's length apart, wherever they stand in the text."""
    item = "measure the width of the old canal before you draw its second lock"
    short = item.replace("width", "wdh").replace("canal", "cnl")
    rows = ["z" * n + " " + short + short + " end" for n in range(2 * len(item))]
    found = D.find(D.Items.of([(7, item)]), pa.array(rows))
    assert [len(x) for x in found] == [2] * len(rows)
