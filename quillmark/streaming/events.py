"""Status, audit and override events as streams. Each function takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROGRESS = {"uploaded": 0.05, "processing": 0.10, "extracting": 0.30, "mapping": 0.50, "grading": 0.70, "completed": 1.0, "failed": 1.0}
LATE, LIMIT_S = "10 minutes", 1200
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def progress(state) -> object:
    out = F.lit(0.0)
    for s, p in PROGRESS.items():
        out = F.when(state == s, p).otherwise(out)
    return out


def latest_status(status: DataFrame) -> DataFrame:
    """The last state of each assessment, of equal times the one of the larger event id."""
    last = status.groupBy("assessment_id").agg(F.max_by(F.struct("state", "ts"), F.struct("ts", "event_id")).alias("last"))
    return last.select("assessment_id", "last.state", "last.ts", progress(F.col("last.state")).alias("progress"))


def audit_rates(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events of each type in tumbling windows; what is later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def dedupe_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once. A batch has no watermark and drops all repeats."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


HELD = 1 << 18  # overrides that a task folds at once


def last_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last override of each question among HELD ones or more: all that a fold by time needs of them. Keyed state is
    handed its rows one by one, which costs far more than this."""

    def fold(some: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(some).sort_by([("at", "ascending"), ("event_id", "ascending")])
        last = table.group_by(["assessment_id", "question_id"], use_threads=False).aggregate([(c, "last") for c in ("at", "event_id", "cents")])
        return pa.Table.from_arrays([last.column(c if c in last.column_names else f"{c}_last") for c in table.column_names], table.column_names).to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield from fold(held)
            held, n = [], 0
    if n:
        yield from fold(held)


class Totals(StatefulProcessor):
    """The running totals of one assessment: its questions' last marks, their sum and number.

    An override that is older than the one kept changes nothing, so that the order of arrival doesn't matter. A batch's
    overrides are folded first, and all that an assessment keeps is one value, so that a batch reads and writes it once,
    however many overrides and questions it brings. What is kept goes after ``keep_ms`` without a change; an override after
    that counts anew.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "marks array<struct<question_id: string, at: long, event_id: long, cents: long>>", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.marks.get()  # None where there is none
        known = {m[0]: tuple(m[1:]) for m in kept[0]} if kept is not None else {}
        changed = False
        for row in rows:
            old, new = known.get(row.question_id), (row.at, row.event_id, row.cents)
            if old is None or new[:2] > old[:2]:
                known[row.question_id], changed = new, True
        if changed:
            self.marks.update(([(q, *m) for q, m in known.items()],))
        yield Row(assessment_id=key[0], cents=sum(m[2] for m in known.values()), questions=len(known))

    def close(self) -> None:
        pass


def live_totals(overrides: DataFrame, keep_days: int = 400) -> DataFrame:
    """A stream of the totals (assessment_id, marks, questions) of each assessment that a batch changes: the last is the truth.

    overrides: assessment_id, question_id, ts, event_id, marks (decimals of 2 places; null: ignored). A fold over keyed
    state: a batch costs what it brings, whatever has come before. Each task folds its overrides first (``last_of_each``).
    """
    rows = overrides.where("marks is not null").select("assessment_id", F.coalesce("question_id", F.lit("")).alias("question_id"), F.unix_micros("ts").alias("at"), "event_id", (F.col("marks") * 100).cast("long").alias("cents"))
    rows = rows.mapInArrow(last_of_each, rows.schema)
    out = rows.groupBy("assessment_id").transformWithState(Totals(keep_days * 86_400_000), "assessment_id long, cents long, questions long", "Update", "ProcessingTime")
    return out.select("assessment_id", (F.col("cents") / 100).cast("decimal(18,2)").alias("marks"), "questions")


class Watch(StatefulProcessor):
    """Runs of one assessment that go on for too long.

    Events wait in a list until the watermark has passed them, then count in the order of their time: the order of arrival
    doesn't matter. A run begins with the first processing state after the last run, and ends with completed or failed, or
    as failed when its time is over.
    """

    def __init__(self, limit_s: int):
        self.limit = limit_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, state string")
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r.at, r.event_id, r.state) for r in rows]
        self.waiting.appendList(fresh)
        self.handle.registerTimer(self.due(min(at for at, _, _ in fresh)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        since, out = self.since.get()[0] if self.since.exists() else None, []
        for at, _, state in [*ready, (now, None, None)]:
            if since is not None and at - since > self.limit:
                out.append(since)
                since = None
            if state == "processing" and since is None:
                since = at
            elif state in ("completed", "failed"):
                since = None
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(self.due(later[0][0]))
        if since is None:
            self.since.clear()
        else:
            self.since.update((since,))
            self.handle.registerTimer(self.due(since + self.limit + 1))
        return (Row(assessment_id=key[0], started=at, state="failed") for at in out)

    def close(self) -> None:
        pass

    @staticmethod
    def due(micros: int) -> int:
        return -(-micros // 1000)


def stuck_assessments(status: DataFrame, limit_s: int = LIMIT_S, late: str = LATE) -> DataFrame:
    """assessment_id, started, state (failed) of each run that goes on for more than ``limit_s`` seconds of event time.

    status: assessment_id, ts, event_id, state. A run is told once, however many processing states it has, and when the
    watermark (``late`` behind the latest event) is beyond its time; what comes later than the watermark is dropped.
    """
    rows = status.withWatermark("ts", late).select("assessment_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "state")
    out = rows.groupBy("assessment_id").transformWithState(Watch(limit_s), "assessment_id long, started long, state string", "Append", "EventTime")
    return out.select("assessment_id", F.timestamp_micros("started").alias("started"), "state")


def read_events(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """A stream over Parquet files; ``path`` may be a pattern."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).parquet(path)


#: Several states and timers of one key need RocksDB as state store.
KEYED = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: State that goes with time asks for batches without data for ever; a run over what is there has to end.
ENDING = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]) -> Iterator[None]:
    """Settings for the streams that start meanwhile."""
    before = {k: spark.conf.get(k) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_now(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its result back. Append goes to Parquet, complete keeps the last batch's rows."""
    spark = stream.sparkSession
    out, mark = f"{folder}/out", f"{folder}/mark"
    with settings(spark, KEYED):
        if mode == "append":
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        else:

            def put(batch: DataFrame, i: int) -> None:
                batch.write.mode("overwrite").parquet(out)

            stream.writeStream.foreachBatch(put).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_updates(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """Run a stream of updates over what is there; the last row of each key. A batch that runs again replaces its own rows."""
    spark = stream.sparkSession
    out = f"{folder}/out"

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    with settings(spark, KEYED | ENDING):
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/mark").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")
