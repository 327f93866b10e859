"""Importance resampling towards a target distribution, by hashed runs of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

# Words, buckets, the draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_BUCKETS = 10_000
RUNS = (1, 1)
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

PIECE = 1 << 20  # characters that are split at once; a piece ends where no word goes on
KNOWN = 1 << 18  # words whose buckets a task remembers at once
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NO_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
FEATURES_DDL = "doc_id long, n_words long, n_features long, buckets binary"


def pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about PIECE characters, cut only before characters that are in no word."""
    begin = 0
    while len(text) - begin > PIECE:
        cut = NO_WORD.search(text, begin + PIECE)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def bucketer(runs: tuple[int, int], n_buckets: int) -> Callable[[str], tuple[int, list[int]]]:
    """A function from a text to its number of words and the bucket of each of its features.

    The words and their offsets come from an untrained Regex Split of the lower-cased text. A feature of k words is the
    window between a pair of offsets k - 1 words apart, its words joined by one space.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(WORD), "removed", invert=True)
    known: dict[str, int] = {}

    def bucket(feature: str) -> int:
        got = known.get(feature)
        if got is None:
            if len(known) >= KNOWN:
                known.clear()
            got = known[feature] = zlib.crc32(feature.encode()) % n_buckets
        return got

    def run(text: str) -> tuple[int, list[int]]:
        lower = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
        n_words, out = 0, []
        tail: list[str] = []  # the words before this piece that its first windows begin with
        for piece in pieces(lower):
            windows = split.pre_tokenize_str(piece)
            n_words += len(windows)
            if runs == (1, 1):
                out.extend([bucket(word) for word, _ in windows])
                continue
            words = tail + [piece[a:b] for _, (a, b) in windows]
            for k in range(runs[0], runs[1] + 1):
                fresh = max(0, len(tail) - k + 1)  # windows inside the tail are counted
                out.extend(bucket(" ".join(words[i : i + k])) for i in range(fresh, len(words) - k + 1))
            tail = words[len(words) - runs[1] + 1 :] if runs[1] > 1 and len(words) >= runs[1] else words if runs[1] > 1 else []
        return n_words, out

    return run


def featured(runs: tuple[int, int], n_buckets: int) -> Callable:
    """Texts to FEATURES_DDL: the bucket of each feature, unsigned, 2 bytes each where that does and 4 else."""
    width = bucket_type(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of = bucketer(runs, n_buckets)
        for batch in batches:
            n_words, n_features, packed = [], [], []
            for value in batch.column("text"):
                n, buckets = buckets_of(value.as_py() or "")
                n_words.append(n)
                n_features.append(len(buckets))
                packed.append(np.array(buckets, width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return run


def bucket_type(n_buckets: int) -> str:
    return "<u2" if n_buckets <= 1 << 16 else "<u4"


def flat(batch: pa.RecordBatch, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows of a batch, and how many each row has."""
    raw = batch.column("buckets").to_pylist()
    return np.frombuffer(b"".join(raw), width), np.array([len(b) for b in raw], np.int64) // np.dtype(width).itemsize


def histogram(n_buckets: int) -> Callable:
    """One row of counts for each bucket that a task has seen: at most n_buckets rows a task."""
    width = bucket_type(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch, width)[0], minlength=n_buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["bucket", "n"])

    return run


def weighed(gains: np.ndarray) -> Callable:
    """Rows of features with the sum of the gains of their buckets as weight, without the buckets."""
    width = bucket_type(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, size = flat(batch, width)
            sums = np.concatenate([[0], np.cumsum(gains[buckets], dtype=np.int64)])
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_words", "n_features")] + [pa.array(sums[end] - sums[end - size], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def counts(features: DataFrame, n_buckets: int) -> DataFrame:
    return features.select("buckets").mapInArrow(histogram(n_buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """The gain of each bucket: floor(1000 * ln of the smoothed target share over the smoothed source share).

    Every task sends at most n_buckets counts, and n_buckets gains reach the driver, whatever the size of the tables.
    """
    buckets = source.sparkSession.range(n_buckets).select(F.col("id").alias("bucket"))
    both = buckets.join(counts(source, n_buckets).withColumnRenamed("n", "s"), "bucket", "left").join(counts(target, n_buckets).withColumnRenamed("n", "t"), "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for row in rows:
        s[row.bucket], t[row.bucket] = row.s, row.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))).astype(np.int64)


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))) where u comes from a hash of the id; a null id is hashed as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with rank (1, 2, 3, ... in ``order``), by one distributed sort: no task sees all rows.

    The sorted rows are written with their partition and their place in it; the sizes of the partitions before, one number
    each, make the places ranks.
    """
    place = F.monotonically_increasing_id()  # the partition, then 33 bits for the row
    done = materialize(rows.orderBy(*order).withColumn("place", place), name)
    part = F.shiftright("place", 33)
    sizes = sorted(done.groupBy(part.alias("part")).count().collect())
    ahead, total = [], 0
    for at, n in sizes:
        ahead.append((at, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(ahead, "part long, ahead long")
    return done.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("part", "place", "ahead")


def resample(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = RUNS, n_buckets: int = N_BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` (doc_id, text), drawn towards the texts of ``target``.

    Texts are split as ``bucketer`` says, with ``runs`` (from, to) words a feature. Of the rows with ``least_words`` words or
    more, ``percent`` in a hundred are drawn, highest score first, ties to the smaller doc_id, then to the row that comes
    first: they have a rank. A null or empty text has no feature, weight 0 and no rank, a null doc_id comes last among
    ties, rows that repeat are weighed and drawn one by one, and an empty table gives no row; an empty target only smooths.
    Other columns are ignored, whatever their names.

    Each text is split once: the buckets of its features are written, a third of its size or so, and both the counts and
    the weights are read from there.
    """
    features = lambda some, name: materialize(some.mapInArrow(featured(runs, n_buckets), FEATURES_DDL), name)
    source = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "features")
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target")
    rows = source.mapInArrow(weighed(gains_of(source, goal, n_buckets)), "doc_id long, n_words long, n_features long, weight long")
    rows = materialize(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "weights")
    enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(enough).count() // 100
    placed = ranked(rows.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "ranks")
    shown = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*shown, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(rows.where(~enough).select(*shown, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 goes over the bytes of each different word, with the table of the reflected polynomial 0xEDB88320.
ORACLE = r"""
with steps as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc),
d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from documents),
b as (select regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from benchmark),
dw as materialized (select doc_id, word, count(*) n from (select doc_id, unnest(w) word from d) group by all),
bw as materialized (select word, count(*) n from (select unnest(w) word from b) group by all),
words as (select distinct word from (select word from dw union all select word from bw)),
hashed as materialized (
  select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint)),
    lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1])), 4294967295) % 10000 bucket
  from (select word, hex(encode(word)) h from words), steps),
s as (select bucket, sum(n)::bigint n from dw join hashed using (word) group by all),
t as (select bucket, sum(n)::bigint n from bw join hashed using (word) group by all),
totals as (select coalesce((select sum(n) from s), 0)::double sn, coalesce((select sum(n) from t), 0)::double tn),
gains as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (sn + 10000) / ((s.n + 1)::double * (tn + 10000))))::bigint gain from s left join t using (bucket), totals),
w as (select doc_id, sum(n * gain)::bigint weight, sum(n)::bigint n_features from dw join hashed using (word) join gains using (bucket) group by doc_id),
scored as (
  select d.doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint score
  from d left join w using (doc_id)),
ranks as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) r from scored)
select doc_id, n_features::bigint n_features, weight::bigint weight, score::bigint score,
  case when n_features >= 20 and r <= (select 10 * count(*) // 100 from scored where n_features >= 20) then r::bigint end as rank
from ranks
"""
