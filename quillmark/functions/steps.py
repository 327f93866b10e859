"""Steps of an operator that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (tests on one machine), a fresh local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` as Parquet in the shared folder: its lineage is cut, and executors that are lost take none of it with them.

    ``tidy``: Spark may remove the shuffle files of the write when it is over."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEAN_UP, "false")
    if tidy:
        df.sparkSession.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys`` before they are collected into lists, in four times as many parts as other shuffles.

    Of small groups a list isn't shorter than its rows, but to make one before the shuffle Spark sorts all rows of a task,
    and a task that reads a whole file block has more of them than memory. The parts are many for the same reason: lists are
    sorted once more after the shuffle, and then fit."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
