"""Which hashes of a corpus occur in more than one document: one pre-aggregated shuffle of packed hashes.

Documents are read in blocks. A block sorts its hashes, keeps what it already knows to be shared, and sends every
distinct hash once, packed bucket by bucket, so that a hash which a third of the corpus holds costs one entry for
each block and not one for each document. A bucket answers each block with the hashes that other blocks hold too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .hashing import U, Words, bucket_of, runs_of, shingle_sets, slices, text_bytes

#: One row for each block and bucket. meta rows describe the block itself: its documents, their sizes, what is shared inside it.
PACKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("meta", pa.bool_()), ("ids", pa.binary()), ("sizes", pa.binary()), ("refs", pa.binary()), ("hashes", pa.binary())])
PACKED_DDL = "bucket int, block long, meta boolean, ids binary, sizes binary, refs binary, hashes binary"
SETS_DDL = "doc_id long, n_shingles long, hashes array<long>"
BLOCK_BYTES = 4 << 20
NOBODY = np.uint16(0xFFFF)


def dropped_bits(buckets: int) -> np.uint64:
    """A token is the upper bits of a hash: 40 and as many as tell the buckets apart, so that the difference of
    neighbours in a full row fits 4 bytes and the share of accidental matches doesn't grow with the corpus."""
    return U(max(0, 24 - max(1, buckets).bit_length()))


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted values as first value and differences, of 4 bytes each where they fit."""
    gaps = np.diff(sorted_values)
    first = sorted_values[:1].astype("<u8").tobytes()
    if not len(gaps) or gaps.max() < U(1 << 32):
        return b"\4" + first + gaps.astype("<u4").tobytes()
    return b"\10" + first + gaps.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, U)
    gaps = np.frombuffer(data, "<u4" if data[0] == 4 else "<u8", offset=9)
    out = np.empty(len(gaps) + 1, U)
    out[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    out[1:] = gaps
    return np.cumsum(out, dtype=U)


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(PACKED), PACKED.types, strict=True)], schema=PACKED)


def send_blocks(n: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, at = text_bytes(batch.column("text"))
            for i, j in slices(at, BLOCK_BYTES):
                for lo in range(i, j, 60_000):  # a reference is of 16 bits
                    part = batch.slice(lo, min(j, lo + 60_000) - lo)
                    yield packed_rows(block_rows(part, block, n, k))
                    block += 1

    return send


def block_rows(part: pa.RecordBatch, block: int, n: int, k: int) -> list[tuple]:
    doc, h = shingle_sets(Words(part.column("text"), True), k)
    ids = np.array(part.column("doc_id"), np.int64)
    sizes = np.bincount(doc, minlength=len(ids)).astype("<u4")
    drop = dropped_bits(n)
    token = h >> drop
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order].astype("<u2")
    begins = np.ones(len(token), bool)
    begins[1:] = token[1:] != token[:-1]
    run = np.cumsum(begins) - 1
    alone = np.bincount(run)[run] == 1 if len(run) else np.zeros(0, bool)
    rows = [(block % n, block, True, ids.tobytes(), sizes.tobytes(), doc[~alone].tobytes(), token[~alone].astype("<u8").tobytes())]
    token, doc = token[begins], np.where(alone[begins], doc[begins], NOBODY).astype("<u2")
    rows += [(b, block, False, None, None, doc[x:y].tobytes(), pack(token[x:y])) for b, x, y in runs_of(bucket_of(token << drop, n))]
    return rows


def answer_bucket(key: tuple, got: pa.Table) -> pa.Table:
    """The entries of one bucket that more than one block sent, back to their blocks."""
    got = got.combine_chunks()
    meta = got.filter(got.column("meta"))
    own = got.filter(pa.compute.invert(got.column("meta")))
    out = []
    if own.num_rows:
        parts = [unpack(x) for x in own.column("hashes").to_pylist()]
        refs = [np.frombuffer(x, "<u2") for x in own.column("refs").to_pylist()]
        token, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(token, kind="stable")
        same = token[order[1:]] == token[order[:-1]]
        shared = np.zeros(len(token), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        ref = np.concatenate(refs)
        keep = shared & (ref != NOBODY)
        token, ref, row = token[keep], ref[keep], row[keep]
        ends = np.searchsorted(row, np.arange(len(parts) + 1))
        blocks = own.column("block").to_pylist()
        out = [(None, blocks[r], False, None, None, ref[x:y].tobytes(), pack(token[x:y])) for r, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
    return pa.concat_tables([meta.cast(PACKED), pa.Table.from_batches([packed_rows(out)])])


def gather_block(hundredths: int) -> Callable:
    def gather(key: tuple, got: pa.Table) -> pa.Table:
        """The documents of one block; with the shared hashes of those that have enough of them to be similar to any other."""
        rows = got.to_pylist()
        meta = next(r for r in rows if r["meta"])
        ids, sizes = np.frombuffer(meta["ids"], np.int64), np.frombuffer(meta["sizes"], "<u4").astype(np.int64)
        token = np.concatenate([np.frombuffer(meta["hashes"], "<u8"), *(unpack(r["hashes"]) for r in rows if not r["meta"])])
        doc = np.concatenate([np.frombuffer(r["refs"], "<u2") for r in [meta, *(r for r in rows if not r["meta"])]])
        count = np.bincount(doc, minlength=len(ids))
        enough = (sizes > 0) & (100 * count >= hundredths * sizes)
        keep = enough[doc]
        token, doc = token[keep], doc[keep]
        order = np.lexsort((token, doc))
        ends = np.cumsum(np.where(enough, count, 0))
        arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(token[order].view(np.int64)), mask=pa.array(~enough))
        return pa.Table.from_arrays([pa.array(ids), pa.array(sizes), arrays], ["doc_id", "n_shingles", "hashes"])

    return gather


def shared_shingles(docs: DataFrame, k: int, hundredths: int, buckets: int) -> DataFrame:
    """doc_id, n_shingles and hashes: the sorted hashes of the shingles that other documents hold too.

    hashes is null where fewer than ``hundredths`` per cent of a document's shingles are shared: such a document
    can't be that similar to any other. ``docs`` has a non-null integer doc_id and should come from files, so that a
    repeated task deals out the same blocks.
    """
    sent = docs.select("doc_id", "text").mapInArrow(send_blocks(buckets, k), PACKED_DDL)
    answered = sent.groupBy("bucket").applyInArrow(answer_bucket, PACKED_DDL)
    return answered.groupBy("block").applyInArrow(gather_block(hundredths), SETS_DDL)
