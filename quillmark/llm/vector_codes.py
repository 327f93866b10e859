"""Compression of vectors to codes of their parts: exact integer k-means under adaptive distance bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries next to the nearest whose bounds are kept at first; fewer later, where fewer are looked at.
CLOSEST = 8
#: A larger component becomes this end: then no distance and no sum of distances leaves the range of a long.
LARGEST = 1 << 27
#: Bounds are kept as 4-byte floats, lowered by this share; distances are compared beyond it only by whole numbers.
SLACK = 1e-5
SPREAD = 16  # keys that the rows of one label are spread over

STATE_DDL = "vec_id long, label string, value binary, code binary, near binary, lower binary, outer binary, error long"
Codebooks = list[np.ndarray]  # for each part, entries x components


def sound(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def edges_of(dim: int, parts: int) -> list[int]:
    """Where the consecutive parts begin, and the end; as equal as can be, the first ones longer by one where they must."""
    return [0, *np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)]).tolist()]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, as whole numbers, of each row of x to each of the entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - entries[None, :, d]) ** 2
    return out


def lowered(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def all_entries(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """The nearest entry (ties to the lower index) of each row of x, its distance, the b next ones, their lower bounds
    and a lower bound for all others. Fewer entries: slots 255, which stand for any other entry."""
    exact = distances(x, entries)
    order = np.argsort(exact, 1, kind="stable")
    n, k = exact.shape
    near, lower = np.full((n, b), 255, np.uint8), np.full((n, b), np.inf, np.float32)
    held = min(b, k - 1)
    near[:, :held] = order[:, 1 : held + 1]
    lower[:, :held] = lowered(np.take_along_axis(exact, order[:, 1 : held + 1], 1))
    outer = lowered(np.take_along_axis(exact, order[:, b + 1 : b + 2], 1)[:, 0]) if k > b + 1 else np.full(n, np.inf, np.float32)
    return order[:, 0].astype(np.uint8), exact[np.arange(n), order[:, 0]], near, lower, outer


def moved_bounds(near: np.ndarray, lower: np.ndarray, outer: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the entries have moved that far: each falls by its entry's way, the outer one by the longest, and
    all are put in order again, so that those under some distance are the first ones."""
    outer = outer - np.float32(moved.max(initial=0) * (1 + SLACK))
    way = np.append(moved, np.zeros(256 - len(moved))) * (1 + SLACK)
    lower = np.where(near == 255, outer[:, None], lower - way[near].astype(np.float32))
    ordered = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    return ordered[:, :-1], outer


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, b: int, code: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, ...]:
    """``all_entries`` for rows whose state of the round before is known, and how many of the b entries each row needed.

    A row's own entry is measured exactly. Entries whose bound lies clearly above that distance are further; the first ones,
    up to the last whose bound doesn't, are measured by whole numbers, which also decides ties. Where the outer bound is
    too low, or a slot stands for any other entry, all are measured.
    """
    if near.shape[1] > b:  # b has shrunk: the first slot that goes is the least of what goes
        near, lower, outer = near[:, :b], lower[:, :b], np.minimum(outer, lower[:, b])
    lower, outer = moved_bounds(near, lower, outer, moved)
    best = ((x - entries[code]) ** 2).sum(1)
    reach = (np.sqrt(best.astype(np.float64)) * (1 + SLACK)).astype(np.float32)
    depth = (lower <= reach[:, None]).sum(1)
    slots = np.arange(near.shape[1])
    whole = (outer <= reach) | ((near == 255) & (slots < depth[:, None])).any(1)
    depth[whole] = near.shape[1]
    code, near, lower, outer = code.copy(), near.copy(), lower.copy(), outer.copy()
    for deep in np.unique(depth[~whole]):
        if not deep:
            continue
        rows = np.flatnonzero(~whole & (depth == deep))
        tried = np.concatenate([code[rows, None], near[rows, :deep]], 1).astype(np.int64)
        exact = ((x[rows, None, :] - entries[tried]) ** 2).sum(2)
        order = np.lexsort((tried, exact), axis=1)
        tried, exact = np.take_along_axis(tried, order, 1), np.take_along_axis(exact, order, 1)
        code[rows], best[rows] = tried[:, 0], exact[:, 0]
        near[rows, :deep] = tried[:, 1:]
        lower[rows, :deep] = lowered(exact[:, 1:])
    # A measured entry may lie further than a slot behind it: in order, bounds stay bounds.
    ordered = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    lower = np.ascontiguousarray(ordered[:, :-1])
    rows = np.flatnonzero(whole)
    if len(rows):
        code[rows], best[rows], near[rows], lower[rows], outer[rows] = all_entries(x[rows], entries, near.shape[1])
    return code, best, near, lower, outer, depth


class Block:
    """The rows of a batch of STATE_DDL as arrays: rows x parts (x slots)."""

    def __init__(self, batch: pa.RecordBatch, dim: int, parts: int):
        n = batch.num_rows
        self.batch = batch
        array = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
        self.value = array("value", "<i4").reshape(n, dim).astype(np.int64)
        self.code = array("code", np.uint8).reshape(n, parts)
        if n:
            self.near, self.lower = array("near", np.uint8).reshape(n, parts, -1), array("lower", "<f4").reshape(n, parts, -1)
            self.outer = array("outer", "<f4").reshape(n, parts)


def rows_of(column: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(column).reshape(len(column), -1)
    return pa.array([row.tobytes() for row in flat], pa.binary())


def state(vec_id: pa.Array, label: pa.Array, value: pa.Array, parts: list[tuple]) -> pa.RecordBatch:
    code, best, near, lower, outer = (np.stack(c, 1) for c in zip(*(p[:5] for p in parts), strict=True))
    columns = [vec_id, label, value, rows_of(code), rows_of(near), rows_of(lower.astype("<f4")), rows_of(outer.astype("<f4")), pa.array(best.sum(1))]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "value", "code", "near", "lower", "outer", "error"])


def first_round(codebooks: Codebooks, edges: list[int], b: int) -> Callable:
    """Vectors as whole numbers, with what ``all_entries`` says of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.clip(np.floor(256 * np.array(batch.column("vector").flatten(), np.float64)), -LARGEST, LARGEST).astype(np.int64).reshape(batch.num_rows, -1)
                yield state(batch.column("vec_id"), batch.column("label"), rows_of(x.astype("<i4")), [all_entries(x[:, lo:hi], c, b) for c, lo, hi in zip(codebooks, edges, edges[1:], strict=False)])

    return run


def next_round(codebooks: Codebooks, moved: list[np.ndarray], edges: list[int], widths: list[int]) -> Callable:
    """The state after the entries have moved; widths: how many of the slots of each part go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, done = Block(batch, edges[-1], len(codebooks)), []
            for p, (entries, lo, hi) in enumerate(zip(codebooks, edges, edges[1:], strict=False)):
                done.append(list(assign(block.value[:, lo:hi], entries, moved[p], widths[p], block.code[:, p], block.near[:, p], block.lower[:, p], block.outer[:, p])))
            most = max(widths)
            for part in done:  # all parts in one array: slots that a part hasn't stand for any other entry
                short = most - part[2].shape[1]
                part[3] = np.concatenate([part[3], np.repeat(part[4][:, None], short, 1)], 1)
                part[2] = np.pad(part[2], ((0, 0), (0, short)), constant_values=255)
            yield state(batch.column("vec_id"), batch.column("label"), batch.column("value"), done)

    return run


def sums(edges: list[int], k: int) -> Callable:
    """For each part and entry that a task has seen, one row: how many parts, the sum of each component."""
    parts, widest = len(edges) - 1, max(np.diff(edges), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, k, widest), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if batch.num_rows:
                block = Block(batch, edges[-1], parts)
                for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    np.add.at(total[p, :, : hi - lo], block.code[:, p], block.value[:, lo:hi])
                    n[p] += np.bincount(block.code[:, p], minlength=k)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def updated(now: DataFrame, codebooks: Codebooks, edges: list[int]) -> Codebooks:
    """Each entry as the floor of its parts' mean. One row for each part and entry reaches the driver, however many vectors."""
    k, widest = len(codebooks[0]), max(np.diff(edges), default=0)
    each = now.mapInArrow(sums(edges, k), "part int, entry int, n long, total array<long>")
    totals = [F.sum(F.get("total", d)).alias(f"t{d}") for d in range(widest)]
    out = [c.copy() for c in codebooks]
    for row in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        width = out[row.part].shape[1]
        out[row.part][row.entry] = [row[f"t{d}"] // row.n for d in range(width)]
    return out


def widths_after(now: DataFrame, codebooks: Codebooks, moved: list[np.ndarray], edges: list[int], share: float = 0.95) -> list[int]:
    """The adapted b of each part: the fewest slots that do for ``share`` of the rows that need some, one at least.

    Each task counts its rows by the slots that the moved bounds leave under the distance to the own entry.
    """
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, 257), np.int64)
        for batch in batches:
            if batch.num_rows:
                block = Block(batch, edges[-1], parts)
                for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    lower, _ = moved_bounds(block.near[:, p], block.lower[:, p], block.outer[:, p], moved[p])
                    reach = np.sqrt(((block.value[:, lo:hi] - codebooks[p][block.code[:, p]]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
                    n[p] += np.bincount((lower <= reach[:, None]).sum(1), minlength=257)
        part, depth = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(depth, pa.int32()), pa.array(n[part, depth])], ["part", "depth", "n"])

    counted = np.zeros((parts, 257), np.int64)
    for row in now.mapInArrow(run, "part int, depth int, n long").groupBy("part", "depth").agg(F.sum("n").alias("n")).collect():
        counted[row.part, row.depth] = row.n
    out = []
    for n in counted[:, 1:]:
        so_far = np.cumsum(n)
        out.append(1 + int(np.searchsorted(so_far, share * so_far[-1])) if so_far[-1] else 1)
    return out


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, closest: int = CLOSEST) -> tuple[DataFrame, Codebooks]:
    """vec_id, label (as text), code (bytes, an index for each part), error of each sound row of ``vectors`` (vec_id,
    embedding, label), and the codebooks, by ``rounds`` rounds of k-means in whole numbers floor(256 * x) from the parts of
    the ``entries`` (255 at most) rows of the smallest vec_id.

    Rows whose vector is null or holds a null or non-finite component take no part, nor do those of another dimension than
    the row of the smallest vec_id. Components beyond LARGEST become that end. A dimension that ``parts`` doesn't divide
    gives first parts longer by one. Rows that repeat count one by one; of equal vec_ids the smaller vector comes first, rows
    without vec_id come last. Fewer rows than entries: as many entries. No row: no row and no codebook. Other columns are
    ignored, whatever their names.

    The first round measures all entries and writes for each part the ``closest`` next ones with ordered lower bounds and
    an outer bound for the rest; a later round reads them, lowers them by the ways of the entries and measures only what they
    leave open (see ``assign``), with as many slots as the round before it has shown to be worth while. The driver holds
    the codebooks and sums for their entries, never rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")).where(sound(F.col("vector")))
    begin = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    shown = ("vec_id", "label", "code", "error")
    if not begin:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    dim = len(begin[0].vector)
    whole = np.array([r.vector for r in begin if len(r.vector) == dim], np.float64).reshape(-1, dim)
    whole = np.clip(np.floor(256 * whole), -LARGEST, LARGEST).astype(np.int64)
    edges = edges_of(dim, parts)
    codebooks = [whole[:, lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]
    widths = [min(closest, max(1, len(whole) - 1))] * parts
    now = materialize(rows.where(F.size("vector") == dim).mapInArrow(first_round(codebooks, edges, widths[0]), STATE_DDL), "codes")
    for _ in range(rounds):
        fresh = updated(now, codebooks, edges)
        moved = [np.sqrt(((a - b) ** 2).sum(1).astype(np.float64)) for a, b in zip(fresh, codebooks, strict=True)]
        codebooks, widths = fresh, [min(a, b) for a, b in zip(widths, widths_after(now, fresh, moved, edges), strict=True)]
        now = materialize(now.mapInArrow(next_round(codebooks, moved, edges, widths), STATE_DDL), "codes")
    return now.select(*shown), codebooks


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of error over the rows of the same label, nulls together.

    Errors are added up before rows meet, so that the other side of the join has a row for each label; rows of a common
    label are spread over SPREAD keys, and so is that label's sum.
    """
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int"))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    each = by_label.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(each, salted.label.eqNullSafe(each.of) & (salted.salt == each["at"])).select(*codes.columns, "label_error")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle() -> str:
    """Rounds of plain k-means over all pairs of parts and entries, written out."""
    nearest = """
near{r} as materialized (
  select vec_id, part, x, arg_min(entry, (d, entry)) entry, min(d) d from (
    select v.vec_id, v.part, v.x, c.entry, list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d
    from v join c{r} c on v.part = c.part) group by all)"""
    move = """
m{n} as (select part, entry, pos, floor(sum(x)::decimal(38, 0) / count(*))::bigint m from (
    select part, entry, unnest(x) x, unnest(range(len(x))) pos from near{r}) group by all),
c{n} as materialized (
  select c.part, c.entry, coalesce((select list(m order by pos) from m{n} m where m.part = c.part and m.entry = c.entry), c.c) c from c{r} c)"""
    steps = [nearest.format(r=0)]
    for r in range(ROUNDS):
        steps += [move.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return f"""
with w as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select vec_id, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] x from w, range({PARTS}) t(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 entry, x c from v
       where vec_id in (select vec_id from w order by vec_id limit {ENTRIES})),
{",".join(steps)},
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) s from c{ROUNDS}),
codes as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from near{ROUNDS} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, s codebooks_sha256
from codes join w using (vec_id), book
"""


ORACLE = oracle()
