"""What several of the training-data operators share: the shared folder, materialised steps, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []  # what was written inside of each open ``passing``, the innermost last
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of the steps that are written


_held: dict = {}  # of a Python worker


def held(key: tuple, build: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task. It is one thing: what another stage built before goes first."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (tests), a fresh local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Steps that are written inside are removed when it ends, so that a long operator holds what it still reads only.

    ``lasting`` steps outlive it: they belong to the next one outside, if there is any. What is returned may read these alone.
    """
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def discard(step: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``step`` before its ``passing`` ends: nothing reads it any more. Any other frame is let be."""
    if step in _folders:
        remove(step.sparkSession, _folders.pop(step))


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The copy is replicated as that file system does, so a lost executor costs nothing that was written. As nothing reads
    the step's shuffle files afterwards, Spark may remove them when the write is over. See ``passing`` for ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_passing) > lasting:
        _passing[-1 - lasting].append(path)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    step = spark.read.schema(df.schema).parquet(path)
    _folders[step] = path
    return step


def n_buckets(docs: DataFrame, rows_each: int = 4000) -> int:
    """How many buckets to deal the hashes of ``docs`` into, so that one bucket stays small at every input size."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * parts, -(-docs.count() // rows_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priority(node: str) -> Column:
    return F.struct(F.xxhash64(F.col(node), F.lit(17)).alias("h"), F.col(node).alias("node"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is named by its smallest node.

    Distributed union-find by contraction. In each round every group joins the neighbour that comes first in a
    hashed order, edges are renamed to the groups, and loops and repeats go. The hashed order makes the number of
    rounds logarithmic even for long chains. A round is a pre-aggregated minimum and two joins by group (a very large
    group is one key there: AQE's skew split divides it); its parents and links are written to the shared folder, and
    the parents of all rounds, fewer each time, are followed once at the end.
    Nulls and self-loops are ignored. No edges: no rows.
    """
    with passing(edges.sparkSession):
        links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
        links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        groups = links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
        first = True
        while not links.isEmpty():
            both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy("a").agg(F.min(priority("b")).alias("m"))
            parent = materialize(best.select(F.col("a").alias("old"), F.least(priority("a"), F.col("m"))["node"].alias("new")), "parent")
            left = links.join(parent, links.a == parent.old).select(F.col("new").alias("a"), "b")
            right = left.join(parent, left.b == parent.old).select("a", F.col("new").alias("b"))
            links = materialize(right.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
            if first:
                groups, first = parent.select(F.col("old").alias("node"), F.col("new").alias("root")), False
            else:
                groups = groups.join(parent, groups.root == parent.old, "left").select("node", F.coalesce("new", "root").alias("root"))
        groups = materialize(groups, "groups", lasting=True)
    names = groups.groupBy("root").agg(F.min("node").alias("component"))
    return groups.join(names, "root").select("node", "component")


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) of ``connected_components`` after more links (a, b): union-find of what is named so far."""
    if links.isEmpty():
        return components
    with passing(links.sparkSession):
        now = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        between = links.join(now("a"), "a", "left").join(now("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        renamed = materialize(connected_components(between).select(F.col("node").alias("old"), F.col("component").alias("new")), "renamed")
        old = components.join(renamed, components.component == renamed.old, "left").select("node", F.coalesce("new", "component").alias("component"))
        fresh = renamed.join(components, renamed.old == components.component, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        return materialize(old.union(fresh), "components", lasting=True)
