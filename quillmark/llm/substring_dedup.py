"""Removal of long repeated word passages, found by difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_buckets, table
from .hashing import U, Words, bucket_of, runs_of
from .shared_hashes import dropped_bits, pack, unpack

#: Any two positions have a shift below PERIOD that takes both to cover positions: every remainder is a difference of two of these.
PERIOD, COVER = 7, np.isin(np.arange(7), (0, 1, 3))
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary())])
SENT_DDL = "bucket int, block int, hashes binary, owners binary"
BLOCK_DOCS, BLOCK_BYTES = 1500, 8 << 20  # of a block, on average: a block is one group of a task


def in_order(got: pa.Table) -> tuple[np.ndarray, Words]:
    """The documents of a block in a fixed order, and their words."""
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return np.array(got.column("doc_id"), np.int64), Words(got.column("text"), False)


def anchors(words: Words, window: int, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Positions and tokens of the anchors of all texts that hold a window."""
    at, h = words.runs(window - PERIOD + 1)
    text = words.owner(at)
    keep = COVER[(at - words.first[text]) % PERIOD] & (np.diff(words.first) >= window)[text]
    return at[keep], h[keep] >> drop


def sent_rows(block: int, values: np.ndarray, hashes: np.ndarray, owners: np.ndarray | None, n: int) -> pa.Table:
    """Sorted values, dealt out by the bucket of the hashes that they stand for."""
    full = runs_of(bucket_of(hashes, n))
    return pa.Table.from_arrays([pa.array([b for b, _, _ in full], pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array([pack(values[x:y]) for _, x, y in full], pa.binary()), pa.array([None if owners is None else pack_ids(owners[x:y]) for _, x, y in full], pa.binary())], schema=SENT)


def pack_ids(ids: np.ndarray) -> bytes:
    """Any integers; of 4 bytes each where their range allows it."""
    low = ids.min()
    small = int(ids.max()) - int(low) < 1 << 32
    return (b"\4" if small else b"\10") + low.astype("<i8").tobytes() + (ids - low).astype("<u4" if small else "<i8").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<i8", offset=9).astype(np.int64) + np.frombuffer(data, "<i8", 1, 1)[0]


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts values, and where in it each different value begins."""
    order = np.argsort(values, kind="stable")
    begins = np.ones(len(values), bool)
    begins[1:] = values[order[1:]] != values[order[:-1]]
    return order, begins


def member(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values are in a pool (sorted here)."""
    if not len(pool):
        return np.zeros(len(values), bool)
    pool = np.sort(pool)
    return pool[np.minimum(np.searchsorted(pool, values), len(pool) - 1)] == values


def gathered(answers: pa.Table) -> np.ndarray:
    parts = [unpack(x) for x in answers.column("hashes").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, U)


def send_anchors(window: int, n: int):
    def send(key: tuple, got: pa.Table) -> pa.Table:
        _, words = in_order(got)
        drop = dropped_bits(n)
        token = np.unique(anchors(words, window, drop)[1])
        return sent_rows(key[0].as_py(), token, token << drop, None, n)

    return send


def shared_anchors(key: tuple, got: pa.Table) -> pa.Table:
    """To each block, its anchors that another block has too."""
    parts = [unpack(x) for x in got.column("hashes").to_pylist()]
    token, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order, begins = groups_of(token)
    single = begins & np.append(begins[1:], True)
    keep = np.zeros(len(token), bool)
    keep[order[~single]] = True
    return answer(got, token[keep], row[keep])


def answer(got: pa.Table, value: np.ndarray, row: np.ndarray) -> pa.Table:
    ends = np.searchsorted(row, np.arange(got.num_rows + 1))
    full = [(r, x, y) for r, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
    return pa.Table.from_arrays([got.column("block").take(pa.array([r for r, _, _ in full], pa.int64())), pa.array([pack(value[x:y]) for _, x, y in full], pa.binary())], ["block", "hashes"])


def send_windows(window: int, n: int):
    def send(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The different windows round shared anchors, each with the smallest document of the block that has it."""
        ids, words = in_order(docs)
        at, token = anchors(words, window, dropped_bits(n))
        order, begins = groups_of(token)
        single = begins & np.append(begins[1:], True)
        hot = member(token, gathered(answers))
        hot[order[~single]] = True
        near = np.zeros(len(words) + 1, np.int64)  # a window that starts up to PERIOD - 1 words before an anchor holds it
        at = at[hot]
        np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        at, h = words.runs(window)
        keep = np.cumsum(near)[at] > 0
        at, h = at[keep], h[keep]
        order, begins = groups_of(h)
        owner = ids[words.owner(at[order])]
        first = np.flatnonzero(begins)
        owners = np.minimum.reduceat(owner, first) if len(first) else owner
        return sent_rows(key[0].as_py() if key[0] is not None else 0, h[order][begins], h[order][begins], owners, n)

    return send


def owned_elsewhere(key: tuple, got: pa.Table) -> pa.Table:
    """To each block, its windows that a smaller document of another block has."""
    parts = [unpack(x) for x in got.column("hashes").to_pylist()]
    h, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    owner = np.concatenate([unpack_ids(x) for x in got.column("owners").to_pylist()])
    order, begins = groups_of(h)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(begins))[np.cumsum(begins) - 1]
    keep = np.zeros(len(h), bool)
    keep[order[owner[order] > least]] = True
    return answer(got, h[keep], row[keep])


def remove(window: int):
    def remove_covered(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, words = in_order(docs)
        at, h = words.runs(window)
        order, begins = groups_of(h)
        owner = ids[words.owner(at)]
        if len(order):
            least = np.minimum.reduceat(owner[order], np.flatnonzero(begins))[np.cumsum(begins) - 1]
            gone = member(h, gathered(answers))
            gone[order[owner[order] > least]] = True
        else:
            gone = np.zeros(0, bool)
        step = np.zeros(len(words) + 1, np.int64)
        step[at[gone]] += 1
        step[at[gone] + window] -= 1
        kept = np.cumsum(step)[:-1] == 0
        size = (words.end - words.start)[kept]
        ends = np.cumsum(size + 1)
        begin = ends - size - 1
        source = np.repeat(words.start[kept] - begin, size + 1) + np.arange(ends[-1] if len(ends) else 0)
        out = words.raw[np.minimum(source, max(0, len(words.raw) - 1))] if len(source) else np.zeros(0, np.uint8)
        out[ends - 1] = 32
        n_words = np.diff(words.first)
        before = np.concatenate([[0], np.cumsum(kept)])[words.first]  # kept words before each text
        n_kept = np.diff(before)
        edge = np.concatenate([[0], ends])[before]
        data = memoryview(out)
        texts = [bytes(data[x : max(x, y - 1)]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(ids), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return remove_covered


def n_blocks(docs: DataFrame) -> int:
    """How many blocks to deal ``docs`` (text) into, so that one holds few rows and little text, also where all texts are long."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(1, -(-rows // BLOCK_DOCS), -(-(size or 0) // BLOCK_BYTES))


def digest(rest):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = rest(key, docs, answers)
        kept = pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in out.column("kept").combine_chunks()], pa.string())
        return out.set_column(3, "kept_sha256", kept)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space), or, without ``texts``, its kept_sha256.

    Words are runs of bytes other than space and \\x09-\\x0D, unchanged. A word goes if a window of ``window`` words of its
    document covers it whose word sequence also starts in a document with a smaller doc_id; windows are judged on the
    input. Null and empty texts have no words and stay, empty. Rows without doc_id are left out; rows that repeat a
    doc_id are judged one by one and never against each other. Other columns are ignored.

    Anchors of window - PERIOD + 1 words are hashed only at cover positions of each text; equal windows hold an anchor at
    the same place in both, whatever their offsets. So (1) each block of documents sends its different anchors, packed,
    and learns which of them others hold, (2) it extends each of these to the windows that contain it and sends those
    with their smallest document, (3) it removes the windows of which a smaller document is known. A passage that a third
    of the corpus holds is one entry for each block. The text itself is shuffled once: the three steps read one exchange.
    """
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window has {2 * PERIOD - 1} words at least")
    n = n_buckets(docs)
    blocks = max(n, n_blocks(docs))
    dealt = docs.where("doc_id is not null").select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    answers_ddl = "block int, hashes binary"
    anchored = dealt.groupBy("block").applyInArrow(send_anchors(window, n), SENT_DDL).groupBy("bucket").applyInArrow(shared_anchors, answers_ddl)
    windows = dealt.groupBy("block").cogroup(anchored.groupBy("block")).applyInArrow(send_windows(window, n), SENT_DDL)
    owned = windows.groupBy("bucket").applyInArrow(owned_elsewhere, answers_ddl)
    last = dealt.groupBy("block").cogroup(owned.groupBy("block"))
    if texts:
        return last.applyInArrow(remove(window), "doc_id long, n_words long, n_removed long, kept string")
    return last.applyInArrow(digest(remove(window)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
