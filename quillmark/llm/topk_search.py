"""Exact top-k inner-product search pruned by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

QUERY_BLOCK = 4096  # queries that one task holds
ROWS_EACH = 20_000  # candidates that one task holds
TILE = 256  # queries that are bounded at once
SEGMENTS = (1, 4, 16)  # coarse to fine
LARGEST = np.finfo(np.float64).max  # where 256 times a component is more
OUT_DDL = "query_id long, vec_id long, score long"


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of each vector, weighted by the root of a segment's length."""
    parts = np.array_split(x, segments, axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    return np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root


def exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of q and j of x, by Python's integers: for values beyond what a double holds. Products
    beyond what a long holds become its least or largest value."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q[u], x[v], strict=True)), low), high) for u, v in zip(i, j, strict=True)], np.int64)


def paired(q: tuple, x: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows, the sum of the products of several arrays; a million pairs at a time."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 20):
        part = slice(lo, lo + (1 << 20))
        out[part] = sum(np.einsum("ij,ij->i", a[i[part]], b[j[part]]) for a, b in zip(q, x, strict=True))
    return out


DENSE = 0.1  # of a tile's pairs: from this share on a product of matrices costs less than picking pairs


def survivors(q: tuple, x: tuple, alive: np.ndarray, bar: np.ndarray) -> None:
    """Strike out the pairs whose bound is under the bar of their query."""
    if alive.mean() > DENSE:
        alive &= sum(a @ b.T for a, b in zip(q, x, strict=True)) >= bar[:, None]
    else:
        i, j = np.nonzero(alive)
        gone = paired(q, x, i, j) < bar[i]
        alive[i[gone], j[gone]] = False


def search_tile(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, stats: list[tuple], levels: list[int], k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alive = ids[None, :] != own[:, None]
    if whole and stats and len(ids) > 8 * k:
        coarse = statistics(q, levels[0])
        bound = np.where(alive, sum(a @ b.T for a, b in zip(coarse, stats[0], strict=True)), -np.inf)
        probe = np.argpartition(-bound, 4 * k, 1)[:, : 4 * k]  # most promising first: they set the bar
        score = np.where(np.take_along_axis(alive, probe, 1), np.einsum("id,ijd->ij", q, x[probe]), -np.inf)
        bar = np.sort(score, 1)[:, -k]
        bar = np.where(np.isfinite(bar), bar - 1e-6 * (np.abs(np.where(np.isfinite(bar), bar, 0)) + 1), -np.inf)
        alive &= bound >= bar[:, None]
        for s, fine in zip(levels[1:], stats[1:], strict=True):
            survivors(statistics(q, s), fine, alive, bar)
    if not whole:
        i, j = np.nonzero(alive)
        score = exact(q, x, i, j)
    elif alive.mean() > DENSE:
        all_scores = np.where(alive, q @ x.T, -np.inf)
        least = np.partition(all_scores, -k, 1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
        i, j = np.nonzero(alive & (all_scores >= least[:, None]))
        score = all_scores[i, j].astype(np.int64)
    else:
        i, j = np.nonzero(alive)
        score = paired((q,), (x,), i, j).astype(np.int64)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return own[i[keep]], ids[j[keep]], score[keep]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a block for each query. In a segment the product of two vectors is that of the means
    and at most that of the deviations; the sum over segments bounds the score from above (and, as |q|^2 + |x|^2 - 2qx,
    the distance from below). Candidates whose bound is under the query's k-th best so far go, coarse to fine."""
    whole = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53
    levels = [s for s in SEGMENTS if s <= x.shape[1]]
    stats = [statistics(x, s) for s in levels]
    parts = [search_tile(q_ids[lo : lo + TILE], q[lo : lo + TILE], ids, x, stats, levels, k, whole) for lo in range(0, len(q), TILE)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))  # type: ignore[return-value]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as whole numbers, packed with their ids: a row for each dimension and up to 512 vectors."""
    for batch in batches:
        lists = batch.column("embedding")
        size = np.array(lists.value_lengths(), np.int64)
        with np.errstate(over="ignore"):
            value = np.clip(np.floor(256 * np.array(lists.flatten().cast(pa.float64()))), -LARGEST, LARGEST)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        ids, rows = np.array(batch.column("vec_id"), np.int64), []
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                block = value[begin[part][:, None] + np.arange(d)]
                small = not block.size or np.abs(block).max() < 32_000
                rows.append((int(d), bool(small), ids[part].tobytes(), block.astype("<i2" if small else "<f8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["dim", "small", "ids", "data"])


def unpacked(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.frombuffer(b, np.int64) for b in t.column("ids").to_pylist()]
    data = [np.frombuffer(b, "<i2" if s else "<f8").reshape(-1, dim) if dim else np.zeros((len(i), 0)) for b, s, i in zip(t.column("data").to_pylist(), t.column("small").to_pylist(), ids, strict=True)]
    return np.concatenate(ids), np.concatenate(data).astype(np.float64)


def search(k: int) -> Callable:
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        got = (np.zeros(0, np.int64),) * 3
        if queries.num_rows and vectors.num_rows:
            dim = queries.column("dim")[0].as_py()
            got = search_block(*unpacked(queries, dim), *unpacked(vectors, dim), k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in got], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (integer vec_id, embedding) whose vec_id is divisible by
    ``every``, the ``k`` rows of another vec_id with the highest inner product of floor(256 * x), ties to the smaller vec_id.

    Vectors that are null or hold a null, NaN or infinity take no part, nor do rows without vec_id; only vectors of one
    dimension meet. A score beyond the range of a long is its nearest end, and such scores tie. Fewer than k others: all of them. Rows that repeat a vec_id count one by one; a query that repeats
    is answered once for its vec_id. Other columns are ignored.

    Queries and vectors are packed into blocks; each block of at most QUERY_BLOCK queries meets each block of about
    ROWS_EACH vectors once, in a task of its own, which returns its k best for each query; the best of those win.
    Nothing is broadcast.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    asked = sound.where(F.col("vec_id") % every == 0)
    sides = max(1, -(-asked.count() // QUERY_BLOCK))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sound.count() // ROWS_EACH))
    ddl = "dim int, small boolean, ids binary, data binary"
    shape = ["dim", "side", "slot", "small", "ids", "data"]
    questions = asked.repartition(sides, F.xxhash64("vec_id")).sortWithinPartitions("vec_id").mapInArrow(packed, ddl).withColumn("side", F.pmod(F.xxhash64("ids"), F.lit(sides)).cast("int"))
    questions = questions.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).select(shape)
    pool = sound.mapInArrow(packed, ddl).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int")).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).select(shape)
    found = questions.groupBy("dim", "side", "slot").cogroup(pool.groupBy("dim", "side", "slot")).applyInArrow(search(k), OUT_DDL)
    one = materialize(found, "hits")
    best = one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""
