"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, table
from quillmark.llm.decontaminate import contamination
from quillmark.llm.language_id import labelled
from quillmark.llm.line_dedup import dedup_lines
from quillmark.llm.ngram_join import keep_one
from quillmark.llm.packing import pack_documents

#: A document goes whose text needs more phrases for a letter than this: no learnt language fits it. Clean text needs about 0.2.
NO_LANGUAGE = 0.75


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of doc_id and text as doc_id: what is said of a text then holds for its rows alone, also where
    doc_id is null or repeats."""
    return docs.select(row_key().alias("doc_id"), "text")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``bad`` (doc_id as of ``by_row``) names."""
    bad = bad.select(F.col("doc_id").alias("bad_row")).distinct()
    return docs.join(bad, row_key() == F.col("bad_row"), "left_anti").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null texts too) or in none of the learnt languages; the label stays the input's.
    Rows are judged one by one, by their texts, where they are: none is shuffled. No row: none."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that no verdict has
    told = labelled(plain, docs, text=f"c{docs.columns.index('text')}")
    good = told.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= NO_LANGUAGE))
    return good.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents of which only blank lines are left; n_chars follows the text where a line went.

    Null texts stay, rows that repeat doc_id and text are taken for one text; columns are the input's, but n_lines and
    n_removed hold this stage's counts if the input has columns of these names."""
    done = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.col("text"), F.lit(" \n\t\r")) == "")
    done = done.where(~F.coalesce(emptied, F.lit(False)))
    return done.select(*(F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the one of the smallest doc_id, of each group of linked ones (``keep_one``).

    Rows are judged one by one: copies that share a doc_id or have none go, different texts of one doc_id stay; null and
    empty texts stay; columns are the input's. No row: none."""
    return keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Rows are judged one by one, also those without doc_id; null texts stay."""
    return without(docs, contamination(by_row(docs), table(spark, sf_dir, "benchmark")).where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2,048 tokens (``pack_documents``), longer texts in pieces.

    A null or empty text is one piece, its end token; rows that repeat are packed one by one; other columns don't matter."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("ngram_join", near_copy_stage), ("decontaminate", benchmark_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
