"""Claims and stitching, whose outcome depends on order, against plain sequential Python on random pages."""

import random

from quillmark.operators import graph as GR

NODES = "document_id string, region_id string, page int, text string, x double, y double, width double, height double"
STRUCTURES = "document_id string, page int, ord int, role string, region_ids array<string>, display_number string, display_label string, x double, y double, width double, height double, confidence double, mid_y double"


def overlap(a0, a1, b0, b1):
    return max(0.0, min(a1, b1) - max(a0, b0))


def fit(box, r):
    ox, oy = overlap(box["x"], box["x"] + box["width"], r["x"], r["x"] + r["width"]), overlap(box["y"], box["y"] + box["height"], r["y"], r["y"] + r["height"])
    inside = all(box[a] - 15 <= r[a] + r[s] / 2 <= box[a] + box[s] + 15 for a, s in (("x", "width"), ("y", "height")))
    held = all(r[a] >= box[a] - 5 and r[a] + r[s] <= box[a] + box[s] + 5 for a, s in (("x", "width"), ("y", "height")))
    if ox * oy <= 0 and not inside:
        return 0.0
    share = lambda of: ox * oy / max(1.0, of["width"] * of["height"])
    score = 0.7 if held else 0.5 if inside else 0.0
    score += min(0.5, share(box) * 2.25) + min(0.4, share(r) * 1.4)
    return score + min(0.35, oy / max(1.0, box["height"], r["height"]) * 1.25) + min(0.25, ox / max(1.0, box["width"], r["width"]))


def claims(structures, regions):
    by_id, taken, out = {r["region_id"]: r for r in regions}, set(), []
    heads = {s["region_ids"][0] for s in structures if s["region_ids"]}
    for s in structures:
        ids = s["region_ids"] or []
        if ids and ids[0] not in taken:
            reach = 200.0 if s["height"] is None else max(s["height"], 150.0)
            at = by_id[ids[0]]["y"] if ids[0] in by_id else s["y"] or 0.0
            got = ids[:1] + [i for i in ids[1:] if i not in taken and i not in heads and (i not in by_id or abs(by_id[i]["y"] - at) <= reach)]
        elif s["height"] is not None:
            scored = [(fit(s, r), r) for r in regions if r["region_id"] not in taken]
            scored = [x for x in scored if x[0] >= 0.15]
            top = max((x[0] for x in scored), default=0)
            got = [r["region_id"] for score, r in sorted(scored, key=lambda x: (x[1]["y"], x[1]["x"], x[1]["region_id"])) if score >= max(0.2, 0.5 * top)]
            if not got:
                out.append((s["ord"], f"visual_1_{s['ord']}", "visual", f"visual_1_{s['ord']}"))
        else:
            got = []
        out += [(s["ord"], i, "continuation" if n else "head", got[0]) for n, i in enumerate(got)]
        taken |= {i for i in got if i in by_id}
    return out


def test_claims(spark):
    rng, nodes, structures, want = random.Random(1), [], [], []
    for doc in range(60):
        regions = [{"region_id": f"r{i}", "x": rng.choice([0.0, 300.0]), "y": 20.0 * i, "width": 250.0, "height": rng.choice([15.0, 40.0])} for i in range(rng.randrange(1, 15))]
        page = []
        for n in range(rng.randrange(1, 10)):
            ids = [f"r{rng.randrange(16)}" for _ in range(rng.randrange(4))]
            box = {"x": rng.choice([0.0, 300.0]), "y": 20.0 * rng.randrange(16), "width": rng.choice([100.0, 600.0]), "height": rng.choice([10.0, 60.0, 200.0])} if rng.random() < 0.7 else dict.fromkeys(("x", "y", "width", "height"))
            page.append({"ord": n, "region_ids": list(dict.fromkeys(ids)) or rng.choice([None, []]), **box})
        want += [(f"d{doc}", *c) for c in claims(page, regions)]
        nodes += [(f"d{doc}", r["region_id"], 1, "t", r["x"], r["y"], r["width"], r["height"]) for r in regions]
        structures += [(f"d{doc}", 1, s["ord"], "QUESTION", s["region_ids"], None, None, s["x"], s["y"], s["width"], s["height"], 0.9, None) for s in page]
    rng.shuffle(structures)
    got = GR.claim_regions(spark.createDataFrame(structures, STRUCTURES), spark.createDataFrame(nodes, NODES)).select("document_id", "ord", "region_id", "claim", "head_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {c[3] for c in want} == {"head", "continuation", "visual"}


def test_a_lost_head_claims_by_its_box(spark):
    """The second structure's head is gone: what its box holds of the free regions is its own, and so lost to the third."""
    nodes = [("d", f"r{i}", 1, "t", 0.0, 40.0 * i, 200.0, 30.0) for i in range(4)]
    box = (0.0, 35.0, 210.0, 80.0)
    structures = [("d", 1, 0, "QUESTION", ["r0"], None, None, 0.0, 0.0, 200.0, 30.0, 0.9, None), ("d", 1, 1, "QUESTION", ["r0", "r3"], None, None, *box, 0.9, None), ("d", 1, 2, "OPTION", ["r3", "r2"], None, None, 0.0, 0.0, 9.0, 9.0, 0.9, None)]
    got = GR.claim_regions(spark.createDataFrame(structures, STRUCTURES), spark.createDataFrame(nodes, NODES)).collect()
    assert sorted((r.ord, r.region_id, r.claim, r.head_id) for r in got) == [(0, "r0", "head", "r0"), (1, "r1", "head", "r1"), (1, "r2", "continuation", "r1"), (2, "r3", "head", "r3")]


def stitched(top, bottom, mid):
    bottom = [dict(b, y=b["y"] + mid) for b in bottom]
    child = {i for b in bottom if b["role"] in ("OPTION", "SUBQUESTION") for i in b["region_ids"]}
    tops, used, into = [dict(t) for t in top], set(), {}
    for t in tops:
        own = t["region_ids"]
        for b in bottom:
            differ = any(t[c] and b[c] and t[c] != b[c] for c in ("display_number", "display_label"))
            if b["ord"] in used or t["role"] != b["role"] or t["role"] == "UNKNOWN" or differ:
                continue
            if not (t["y"] < mid and t["y"] + t["height"] >= mid - max(2.5 * t["height"], 80) and b["y"] <= mid + max(2.5 * b["height"], 80) and b["y"] + b["height"] > mid):
                continue
            gap = max(0.0, b["y"] - t["y"] - t["height"])
            beside = max(0.0, max(t["x"], b["x"]) - min(t["x"] + t["width"], b["x"] + b["width"]))
            if not (set(t["region_ids"]) & set(b["region_ids"]) or (gap <= max(2 * t["height"], 2 * b["height"], 75) and beside <= 600)):
                continue
            used.add(b["ord"])
            x, y = min(t["x"], b["x"]), min(t["y"], b["y"])
            t["width"], t["height"] = max(t["x"] + t["width"], b["x"] + b["width"]) - x, max(t["y"] + t["height"], b["y"] + b["height"]) - y
            t["x"], t["y"], t["confidence"] = x, y, max(t["confidence"], b["confidence"])
            t["region_ids"] = t["region_ids"] + [i for i in b["region_ids"] if i not in t["region_ids"] and (t["role"] not in ("QUESTION", "SECTION_HEADER", "INSTRUCTION") or i not in child)]
            into[b["ord"]] = own[0]
            for c in ("display_number", "display_label"):
                t[c] = t[c] or b[c]
    alone = [b for b in bottom if b["ord"] not in used]
    kept = {i for b in alone for i in b["region_ids"]}
    remap = {i: head for n, head in into.items() for b in bottom if b["ord"] == n for i in b["region_ids"] if i not in kept}
    return tops + [dict(b, ord=b["ord"] + 10_000) for b in alone], {k: v for k, v in remap.items() if k != v}


def row(doc, s, mid):
    return (doc, 1, s["ord"], s["role"], s["region_ids"], s["display_number"], s["display_label"], s["x"], s["y"], s["width"], s["height"], s["confidence"], mid)


def test_stitching(spark):
    rng, tops, bottoms, want, moved, grown = random.Random(2), [], [], [], [], 0
    for doc in range(150):
        def half(low, high, ids):
            return [
                {"ord": n, "role": rng.choice(["QUESTION", "OPTION", "OPTION", "UNKNOWN"]), "region_ids": list(dict.fromkeys(f"r{rng.choice(ids)}" for _ in range(rng.randrange(1, 4)))), "display_number": rng.choice([None, None, "", "1", "2"]), "display_label": rng.choice([None, None, None, "a", "b"]), "x": rng.choice([0.0, 900.0]), "y": float(rng.randrange(low, high)), "width": 100.0, "height": float(rng.choice([10, 40, 90])), "confidence": rng.randrange(10) / 10}
                for n in range(rng.randrange(6))
            ]

        top, bottom = half(380, 500, range(8)), half(0, 250, range(5, 14))
        whole, remap = stitched(top, bottom, 500.0)
        grown += len(top) + len(bottom) - len(whole)
        want += [row(f"d{doc}", s, None)[:-1] for s in whole]
        moved += [(f"d{doc}", k, v) for k, v in remap.items()]
        tops += [row(f"d{doc}", s, 500.0) for s in top]
        bottoms += [row(f"d{doc}", s, 500.0) for s in bottom]
    rng.shuffle(tops), rng.shuffle(bottoms)
    whole, remap = GR.stitch_split_pages(spark.createDataFrame(tops, STRUCTURES), spark.createDataFrame(bottoms, STRUCTURES))
    order = ["document_id", "page", "ord", "role", "region_ids", "display_number", "display_label", "x", "y", "width", "height", "confidence"]
    plain = lambda rows: sorted((tuple(c or None if isinstance(c, str) else c for c in r) for r in rows), key=str)
    assert plain(map(tuple, whole.select(order).collect())) == plain(want)
    assert sorted((r.document_id, r.old_id, r.new_id) for r in remap.collect()) == sorted(moved)
    assert grown > 20


def test_hulls_grow(spark):
    """Three bottom structures: the second fits the hull that the first has made, the third that of both; alone neither would."""
    base = {"role": "OPTION", "display_number": None, "display_label": None, "x": 0.0, "width": 100.0, "confidence": 0.5}
    top = [dict(base, ord=0, region_ids=["t"], y=440.0, height=50.0)]
    bottom = [dict(base, ord=n, region_ids=[f"b{n}"], y=y, height=h) for n, (y, h) in enumerate([(60.0, 60.0), (300.0, 125.0), (700.0, 300.0)])]
    for some in ([0, 1, 2], [1], [2], [1, 2]):
        part = [bottom[i] for i in some]
        want = stitched(top, part, 500.0)
        whole, remap = GR.stitch_split_pages(spark.createDataFrame([row("d", s, 500.0) for s in top], STRUCTURES), spark.createDataFrame([row("d", s, 500.0) for s in part], STRUCTURES))
        assert sorted((r.ord, r.region_ids, r.y, r.height) for r in whole.collect()) == sorted((s["ord"], s["region_ids"], s["y"], s["height"]) for s in want[0])
        assert {r.old_id: r.new_id for r in remap.collect()} == want[1] == ({"b0": "t", "b1": "t", "b2": "t"} if len(some) == 3 else {})


def test_orphans(spark):
    base = {"display_number": None, "display_label": None, "x": 0.0, "width": 100.0, "height": 20.0, "confidence": 0.5}
    top = [dict(base, ord=0, role="QUESTION", region_ids=["q0"], y=10.0), dict(base, ord=1, role="QUESTION", region_ids=["q1"], y=200.0)]
    bottom = [dict(base, ord=0, role="OPTION", region_ids=["o"], y=300.0), dict(base, ord=1, role="QUESTION", region_ids=["q2"], y=330.0), dict(base, ord=2, role="SUBQUESTION", region_ids=["s"], y=350.0)]
    whole, _ = GR.stitch_split_pages(spark.createDataFrame([row("d", s, 500.0) for s in top], STRUCTURES), spark.createDataFrame([row("d", s, 500.0) for s in bottom], STRUCTURES))
    assert [(r.source_id, r.target_id, r.relationship) for r in GR.orphan_edges(whole).collect()] == [("o", "q1", "option_of")]
