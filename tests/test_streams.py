"""Keyed state: whatever the order of arrival, streams equal plain folds over the events in the order of their time."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.streaming import events as S


def arrive(spark, folder, rows, schema, batches):
    """Rows in files of their own, read one by one."""
    for i in range(batches):
        some = [r for n, r in enumerate(rows) if n * batches // len(rows) == i]
        spark.createDataFrame(some, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def runs(rows, limit, mark):
    out = []
    for who in {r[0] for r in rows}:
        since = None
        events = sorted((s, i, what) for a, s, i, what in rows if a == who and s <= mark)
        for s, _, what in [*events, (mark, 0, "")]:
            if since is not None and s - since > limit:
                out.append((who, since))
                since = None
            if what == "processing":
                since = s if since is None else since
            elif what in ("completed", "failed"):
                since = None
    return sorted(out)


def test_stuck_out_of_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(6), 1_000_000 + 40 * i + rng.randrange(40), i, rng.choice(["processing", "processing", "completed", "failed", "grading"])) for i in range(400)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(-250, 250))  # later than others by less than the watermark
    stream = arrive(spark, str(tmp_path / "in"), shuffled, "assessment_id long, s long, event_id long, state string", 6)
    out = S.run_now(S.stuck_assessments(stream, 300), str(tmp_path / "run")).select("assessment_id", F.unix_seconds("started").alias("s"), "state").collect()
    want = runs(rows, 300, max(r[1] for r in rows) - 600)
    assert sorted((r.assessment_id, r.s) for r in out) == want and len(want) > 10
    assert {r.state for r in out} == {"failed"}


def test_a_late_completion_ends_its_own_run(spark, tmp_path):
    """completed of an earlier run arrives after the next run's processing: the next run is still told."""
    rows = [(1, 1_000_000, 1, "processing"), (1, 1_000_500, 3, "processing"), (1, 1_000_100, 2, "completed"), (2, 1_010_000, 9, "grading")]
    stream = arrive(spark, str(tmp_path / "in"), rows, "assessment_id long, s long, event_id long, state string", 2)
    out = S.run_now(S.stuck_assessments(stream), str(tmp_path / "run")).select("assessment_id", F.unix_seconds("started").alias("s")).collect()
    assert [tuple(r) for r in out] == [(1, 1_000_500)]


def test_totals_under_late_overrides(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(4), rng.choice(["q1", "q2", "q3", None]), rng.randrange(50), i, rng.choice([None, *range(0, 900, 7)])) for i in range(300)]
    stream = arrive(spark, str(tmp_path / "in"), rows, "assessment_id long, question_id string, s long, event_id long, cents int", 5).withColumn("marks", (F.col("cents") / 100).cast("decimal(18,2)"))
    out = S.run_updates(S.live_totals(stream), str(tmp_path / "run"), "assessment_id").collect()
    last = {}
    for a, q, s, i, cents in rows:
        if cents is not None:
            last[a, q or ""] = max(last.get((a, q or ""), (-1, -1, 0)), (s, i, cents))
    want = {a: (sum(v[2] for k, v in last.items() if k[0] == a), sum(k[0] == a for k in last)) for a in range(4)}
    assert {r.assessment_id: (int(r.marks * 100), r.questions) for r in out} == want


def test_overrides_are_folded_before_they_reach_the_state(monkeypatch):
    """Of many overrides of few questions, a task sends on the last ones, some for each lot that it folds."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice(["", "q1", "q2"]), rng.randrange(30), i, rng.randrange(900)) for i in range(1000)]
    names = ["assessment_id", "question_id", "at", "event_id", "cents"]
    monkeypatch.setattr(S, "HELD", 400)
    batches = pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))).to_batches(max_chunksize=100)
    out = [tuple(r[c] for c in names) for b in S.last_of_each(iter(batches)) for r in b.to_pylist()]
    assert len(out) == 27  # three lots of nine questions

    def last(some):
        kept = {}
        for a, q, *v in some:
            kept[a, q] = max(kept.get((a, q), [-1]), v)
        return kept

    assert last(out) == last(rows) and list(S.last_of_each(iter([]))) == []
