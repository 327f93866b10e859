"""Benchmark decontamination by the q-gram lemma: shared q-grams in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashing import FOLD, SPACE, U, mix, slices, text_bytes

Q = 10
EDITS = 0.08  # of an item's length
ITEM_BYTES = 4 << 20  # of the items that are broadcast at once
BLOCK_BYTES = 4 << 20
BITS = 20
REGIONS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
REGIONS_DDL = "array<struct<item_id: long, start: int, end: int, edits: int>>"


def normal(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z in lower case and each run of white space as one space; where texts begin; where each byte was."""
    space = SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1][at[:-1] < len(raw)]] = True
    was = np.flatnonzero(keep)
    out = FOLD[raw[was]]
    out[space[was]] = 32
    return out, np.searchsorted(was, at), was


def codes(text: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that begins at each byte (Q = 8 bytes and 2 more)."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    text = np.ascontiguousarray(text)
    eight = np.ndarray((n,), "<u8", text.data, 0, (1,))
    two = np.ndarray((n,), "<u2", text.data, 8, (1,))
    with np.errstate(over="ignore"):
        h = eight * U(0x9E3779B97F4A7C15)
        return (h ^ (h >> U(32)) ^ two) * U(0xD6E8FEB86659FD93)


@dataclass
class Items:
    """Benchmark items and the table of their q-grams."""

    ids: np.ndarray
    texts: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    step: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        ids, texts = [], []
        for i, t in sorted(rows):
            raw, at = text_bytes(pa.array([t]))
            ids.append(i)
            texts.append(normal(raw, at)[0])
        size = np.array([len(t) for t in texts], np.int64)
        n = np.maximum(size - Q + 1, 0)
        budget = np.minimum(EDITS * size, 0.75 * n / Q).astype(np.int64)  # the bound stays a quarter of the q-grams at least
        own = [codes(t) for t in texts]
        gram = np.concatenate(own) if own else np.zeros(0, U)
        item, place = np.repeat(np.arange(len(own)), n), np.concatenate([np.arange(k) for k in n]) if own else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        seen = np.zeros(1 << BITS, bool)
        seen[(mix(grams) >> U(64 - BITS)).astype(np.int64)] = True
        return Items(np.array(ids, np.int64), texts, budget, np.maximum(1, n - budget * Q), np.maximum(budget, 4), grams, np.append(first, len(gram)), item[order], place[order], seen)


def align(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of an item in a text among alignments that stay on diagonals low to low + width - 1.

    Rows are the item's characters, columns diagonals. A cell holds edits and the start, the first weighing more.
    """
    unit = 1 << 24
    padded = np.full(len(item) + width + 1, 256, np.int64)
    lo, hi = max(0, low), min(len(text), low + len(padded))
    padded[lo - low : hi - low] = text[lo:hi]
    col = np.arange(width)
    inside = (col + low >= 0) & (col + low <= len(text))
    v = np.where(inside, col, unit * unit >> 8)
    slope = col * unit
    for i, c in enumerate(item.tolist()):
        best = v + unit * (padded[i : i + width] != c)
        best[:-1] = np.minimum(best[:-1], v[1:] + unit)
        v = np.minimum.accumulate(best - slope) + slope
    ends = low + len(item) + col
    v = np.where((ends >= 0) & (ends <= len(text)), v, unit * unit >> 8)
    o = int(v.argmin())
    return int(v[o]) // unit, int(v[o]) % unit + low, int(ends[o])


def apart(found: list[tuple[int, int, int, int]], texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """One of the places (item, start, end, edits) that several bands give for one region: the one of the fewest edits.

    Places of an item are the same region if they begin less than half of its length apart.
    """
    kept: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, start, end, edits in sorted(found, key=lambda r: (r[0], r[3], r[1], r[2])):
        own = kept.setdefault(i, [])
        if all(2 * abs(start - other[1]) >= len(texts[i]) for other in own):
            own.append((i, start, end, edits))
    return [place for own in kept.values() for place in own]


def find(items: Items, column: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    """For each text the regions (item_id, start, end, edits), in code points, that are an item within its edit budget."""
    raw, at = text_bytes(column)
    text, begin, was = normal(raw, at)
    out: list[list] = [[] for _ in range(len(column))]
    h = codes(text)
    if not len(items.grams) or not len(h):
        return out
    hit = np.flatnonzero(items.seen.take((mix(h) >> U(64 - BITS)).astype(np.int64)))
    k = np.minimum(np.searchsorted(items.grams, h[hit]), len(items.grams) - 1)
    doc = np.searchsorted(begin, hit, "right") - 1
    ok = (items.grams[k] == h[hit]) & (hit + Q <= begin[doc + 1])
    hit, k, doc = hit[ok], k[ok], doc[ok]
    many = items.first[k + 1] - items.first[k]
    at_gram = np.repeat(items.first[k] - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(many.sum())
    item, doc, diagonal = items.item[at_gram], np.repeat(doc, many), np.repeat(hit - begin[doc], many) - items.place[at_gram]
    band = diagonal // items.step[item]  # bands are two steps wide and begin at every step
    item, doc, band = np.tile(item, 2), np.tile(doc, 2), np.concatenate([band, band - 1])
    order = np.lexsort((band, item, doc))
    item, doc, band = item[order], doc[order], band[order]
    edge = np.ones(len(item), bool)
    edge[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(item)))
    for f in first[count >= items.need[item[first]]]:
        i, d = int(item[f]), int(doc[f])
        own, budget, step = text[begin[d] : begin[d + 1]], int(items.budget[i]), int(items.step[i])
        low = int(band[f]) * step - budget
        edits, start, end = align(items.texts[i], own, low, 2 * step + 2 * budget + 1)
        if edits <= budget and end > start:
            out[d].append((i, start, end, edits))
    for d, found in enumerate(out):
        if found:
            place = was[begin[d] : begin[d + 1]] - at[d]
            chars = np.cumsum((raw[at[d] : at[d + 1]] & 0xC0) != 0x80)
            regions = []
            for i, start, end, edits in apart(found, items.texts):
                regions.append((int(items.ids[i]), int(chars[place[start]]) - 1, int(chars[place[end - 1]]), edits))
            out[d] = sorted(regions)
    return out


def scan(items) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column("text"))
            for i, j in slices(at, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                found = [[dict(zip(("item_id", "start", "end", "edits"), r, strict=True)) for r in one] for one in find(items.value, part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, REGIONS)], ["doc_id", "regions"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_regions, item_ids and regions for each row of ``docs`` (integer doc_id, text).

    ``benchmark`` has item_id and text. Texts are compared in bytes of UTF-8 with A-Z in lower case and white space as one
    space. An item of m bytes is found where it occurs within k = EDITS * m edits (fewer for items under some 60 bytes, so
    that the bound below stays positive): by the q-gram lemma such a place shares m - Q + 1 - k * Q of the item's q-grams,
    on diagonals no further apart than k. Q-grams are counted in bands of diagonals that overlap by half; a band with that
    many is aligned, within the band. Items that are null or of fewer than Q bytes are never found; null and empty texts
    hold none; repeated rows are judged alike; an empty benchmark finds nothing. Other columns are ignored.

    Items are broadcast, ITEM_BYTES of text at a time: a larger benchmark is dealt into as many parts, and documents are
    read once for each.
    """
    spark = docs.sparkSession
    sound = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = sound.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for p in range(parts):
        rows = [tuple(r) for r in sound.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).collect()]
        found.append(docs.mapInArrow(scan(spark.sparkContext.broadcast(Items.of(rows))), f"doc_id long, regions {REGIONS_DDL}"))
    if parts == 1:
        every = found[0]
    else:  # one row for each document again
        every = found[0]
        rest = found[1]
        for f in found[2:]:
            rest = rest.union(f)
        rest = rest.where(F.size("regions") > 0).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions")))).alias("more"))
        every = every.join(rest, "doc_id", "left").select("doc_id", F.when(F.col("more").isNull(), F.col("regions")).otherwise(F.array_sort(F.concat("regions", "more"))).alias("regions"))
    return every.select("doc_id", (F.size("regions") > 0).alias("contaminated"), F.size("regions").cast("long").alias("n_regions"), F.array_sort(F.array_distinct("regions.item_id")).alias("item_ids"), "regions")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
