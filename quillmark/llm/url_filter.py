"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .url_labels import LABELLED

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path); both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule (verdict, rule) that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Character 3- and 4-grams of host and path, each told apart by where it is from."""

    def of(text: Column, place: str, n: int) -> Column:
        gram = lambda i: F.concat(F.lit(place), F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), gram)).otherwise(F.array().cast("array<string>"))

    framed = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(F.lit("^"), F.lower(path), F.lit("$"))}
    return F.concat(*(of(text, place, n) for place, text in framed.items() for n in (3, 4)))


def featured(rows: DataFrame) -> DataFrame:
    """``rows`` (url) with host, path and features."""
    host, path = split_url(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("grams", grams(F.col("host"), F.col("path")))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows).drop("grams")


def train(labelled: DataFrame):
    """A model from a small table (url, label 0 or 1)."""
    return LogisticRegression(maxIter=60, regParam=0.02, labelCol="label", featuresCol="features").fit(featured(labelled).select("features", F.col("label").cast("double").alias("label")))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score for each row of ``pages`` (page_id, url; other columns are ignored).

    The longest rule that fits decides; else the model blocks what it scores at ``threshold`` or more. A null url, or one
    without ://, has an empty host and path and is judged by the model as such. Repeated rows are judged alike.
    """
    model = train(labelled)
    rows = featured(pages.select("page_id", "url"))
    rows = model.transform(rows).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    score = vector_to_array("probability")[1]
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in LABELLED))
    return spark.range(0, 1, 1, 1).select(F.inline(rows))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), labelled_urls(spark))
