"""Hierarchical best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, materialize, table

PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
BINS = pa.schema([("fill", pa.int32()), ("done", pa.bool_()), ("members", MEMBERS)])
BINS_DDL = "fill int, done boolean, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
LOCAL_ITEMS = 20_000  # that one best-fit run holds
MOST_CACHED = 900_000


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """Byte pair encoding of many words at once: in each step every word merges its first pair of the lowest rank."""

    LONGEST = 24  # bytes of a word
    SLOTS = 1 << 20

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        symbols = byte_symbols()
        self.plain, self.last = (np.array([vocabulary.get(c + tail, -1) for c in symbols], np.int64) for tail in ("", end))
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        key = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.keys, self.value = np.full(self.SLOTS, -1, np.int64), np.full(self.SLOTS, self.NONE, np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        for slot, k, v in zip(self.slot(key).tolist(), key.tolist(), (np.arange(len(pairs)) << 32 | merged).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.SLOTS
            self.keys[slot], self.value[slot] = k, v

    NONE = 1 << 62

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank << 32 | merged symbol of pairs, NONE where there is no merge."""
        key = left << 32 | right
        slot = self.slot(key)
        found = self.value[slot]
        other = np.flatnonzero((self.keys[slot] != key) | (left < 0) | (right < 0))
        found[other] = self.NONE
        other = other[(left[other] >= 0) & (right[other] >= 0)]
        while len(other):  # on to the next slot while there is something else
            slot[other] = (slot[other] + 1) % self.SLOTS
            there = self.keys[slot[other]]
            hit = there == key[other]
            found[other[hit]] = self.value[slot[other[hit]]]
            other = other[~hit & (there >= 0) & (self.keys[(slot[other] - 1) % self.SLOTS] >= 0)]
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of 1 to LONGEST bytes, 4 bytes each."""
        size = np.array([len(w) for w in words])
        width = int(size.max(initial=1))
        at = np.arange(width)
        inside = at < size[:, None]
        symbol = np.full(inside.shape, -1, np.int64)
        symbol[inside] = self.plain[np.frombuffer(b"".join(words), np.uint8)]
        symbol[np.arange(len(words)), size - 1] = self.last[[w[-1] for w in words]]
        rank = np.full((len(words), width), self.NONE, np.int64)  # of each symbol and the next one
        if width > 1:
            rank[:, :-1] = self.look_up(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(-1, width - 1)
        row = np.arange(len(words))
        out = np.full_like(symbol, -1)
        while len(row):
            place = rank.argmin(1)
            best = rank[np.arange(len(row)), place]
            go = best < self.NONE
            if not go.all():
                out[row[~go], :width] = symbol[~go]
                row, symbol, rank, place, best = row[go], symbol[go], rank[go], place[go], best[go]
                if not len(row):
                    break
            # the symbol after the place goes from each word, so that all get shorter by one
            stay = at[:width] != (place + 1)[:, None]
            width -= 1
            symbol, rank = symbol[stay].reshape(-1, width), rank[stay].reshape(-1, width)
            each = np.arange(len(row))
            merged = best & 0xFFFFFFFF
            symbol[each, place] = merged
            before = np.flatnonzero(place > 0)
            rank[before, place[before] - 1] = self.look_up(symbol[before, place[before] - 1], merged[before])
            rank[each, place] = self.NONE
            after = np.flatnonzero(place + 1 < width)
            rank[after, place[after]] = self.look_up(merged[after], symbol[after, place[after] + 1])
        used = out >= 0
        data = out[used].astype("<u4").tobytes()
        edge = [0, *(4 * np.cumsum(used.sum(1))).tolist()]
        return [data[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]


class WordTokenizer:
    """Ids of whole texts by a tokenizer that folds case, drops white space and marks the ends of words.

    As white space separates, the ids of a text are those of its chunks (what stands between spaces and line ends), which
    are encoded once and kept while there is room. Latin-1 texts are lower-cased first, as the tokenizer does. Chunks of
    letters are one word each and are encoded many at a time (``Merges``). Final stops are words of their own. Any other
    chunk is encoded by itself. A text that holds an added token, in either case, goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"].lower() for t in told["added_tokens"]]
        model = told["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.known: dict[str, bytes] = {"": b""}

    def encode_each(self, chunks: list[str]) -> None:
        for chunk, e in zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True):
            self.known[chunk] = np.array(e.ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> None:
        words = sorted(words, key=len)  # of like lengths
        raw = [w.encode() for w in words]
        self.encode_each([w for w, r in zip(words, raw, strict=True) if len(r) > Merges.LONGEST])
        for lo in range(0, len(words), 3000):
            part = [(w, r) for w, r in zip(words[lo : lo + 3000], raw[lo : lo + 3000], strict=True) if len(r) <= Merges.LONGEST]
            if part:
                self.known.update(zip([w for w, _ in part], self.merges.encode([r for _, r in part]), strict=True))

    def learn(self, new: set[str]) -> None:
        words = {c for c in new if c.isalpha() and (c.isascii() or latin(c))}
        ending, odd = [], []
        for chunk in new - words:
            core = chunk.rstrip(".,!?;:")
            if core != chunk and core.isalpha() and latin(core):
                ending.append((chunk, core, chunk[len(core) :]))
            else:
                odd.append(chunk)
        words |= {core for _, core, _ in ending if core not in self.known}
        folded = {w for w in words if w.lower() != w}  # of texts that aren't Latin-1: as the tokenizer folds them
        self.encode_words(list(words - folded))
        self.encode_each([*odd, *folded, *{stop for _, _, stop in ending if stop not in self.known}])
        self.known.update((chunk, self.known[core] + self.known[stop]) for chunk, core, stop in ending)

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, 4 bytes each."""
        split, whole = [], {}
        for i, t in enumerate(texts):
            low = t.lower()
            if "<" in low and any(a in low for a in self.added):
                whole[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                split.append([])
            else:
                split.append((low if latin(t) else t).replace("\n", " ").split(" "))
        chunks = set().union(*split)
        if len(self.known) > MOST_CACHED:
            self.known = {"": b""}
        if new := chunks.difference(self.known):  # looks up the chunks; a difference with keys() would go through all that is kept
            self.learn(new)
        get = self.known.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, s)) for i, s in enumerate(split)]


def pieces(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = held(("words", path), lambda: WordTokenizer(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokenizer.ids([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids = memoryview(ids + end)
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items into bins, largest first, each into the fullest bin that has room. The non-empty gaps are bits of a number."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = gaps >> size
        if room:
            gap = size + (room & -room).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        gap -= size
        if gap:
            by_gap[gap].append(b)
            gaps |= 1 << gap
    return bins


def bin_table(members: list[list[dict]], capacity: int, slack: int) -> pa.RecordBatch:
    fill = [sum(m["length"] for m in b) for b in members]
    return pa.RecordBatch.from_arrays([pa.array(fill, pa.int32()), pa.array([capacity - f <= slack for f in fill], pa.bool_()), pa.array(members, MEMBERS)], schema=BINS)


def pack_local(capacity: int, slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            return bin_table([[held[i] for i in b] for b in best_fit(np.array([h["length"] for h in held], np.int64), capacity)], capacity, slack)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) >= LOCAL_ITEMS:
                    yield flush()
                    held = []
        yield flush()

    return pack


def merge(capacity: int, slack: int) -> Callable:
    def merge_bins(key: tuple, bins: pa.Table) -> pa.Table:
        """Best-fit with underfull bins as the items."""
        own = bins.column("members").to_pylist()
        packed = best_fit(np.array(bins.column("fill"), np.int64), capacity)
        return pa.Table.from_batches([bin_table([[m for i in b for m in own[i]] for b in packed], capacity, slack)])

    return merge_bins


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, sequence = np.array(batch.column("members").value_lengths(), np.int64), np.array(batch.column("sequence_id"))
        flat = batch.column("members").flatten()
        columns = {f.name: flat.field(f.name) for f in MEMBERS.value_type}
        length = np.array(columns["length"], np.int64)
        ends = np.cumsum(length)
        first = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(at)])[:-1]]
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.repeat(sequence, at)), pa.array(ends - length - np.repeat(first, at))], [*columns, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, slack: int = 2, most_rounds: int = 12, least_saved: float = 0.005) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs`` (integer doc_id, text).

    A document is the ids of its text by the tokenizer file ``tokenizer`` and then ``end_id``; a null text is empty. Only a
    document of more than ``capacity`` ids is cut, into pieces of that many; its last piece may be shorter. Pieces of a
    sequence are gapless from 0. No row: no piece. Rows that repeat a doc_id, or have none, are packed like others.

    Hierarchical residual packing: each partition packs its pieces by best fit, bounded runs of ``LOCAL_ITEMS`` at a time;
    bins with ``slack`` or less left are done. The others are merged in a tree: groups of a bounded number of underfull
    bins, as items, are packed by best fit again, until one group has seen them all, a round saves less than the share
    ``least_saved`` of its bins, or ``most_rounds`` are over. Only
    places and checksums move, not ids; each round is written to the shared folder.
    """
    spark = docs.sparkSession
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces(tokenizer, capacity, end_id), PIECES_DDL)
    bins = materialize(cut.mapInArrow(pack_local(capacity, slack), BINS_DDL), "bins")
    whole, left = bins.where("done"), bins.where("not done")
    n = left.count()
    for _ in range(most_rounds):
        if not n:
            break
        groups = -(-n // LOCAL_ITEMS)
        left = left.withColumn("group", F.floor(F.rand(7) * groups) if groups > 1 else F.lit(0))
        again = materialize(left.groupBy("group").applyInArrow(merge(capacity, slack), BINS_DDL), "bins")
        whole, left = whole.union(again.where("done")), again.where("not done")
        before, n = n, left.count()
        if groups == 1 or n > (1 - least_saved) * before:
            break
    every = whole.union(left).withColumn("sequence_id", F.monotonically_increasing_id())
    return every.select("members", "sequence_id").mapInArrow(placed, PIECES_DDL + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
