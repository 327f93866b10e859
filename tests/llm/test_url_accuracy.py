"""Held-out accuracy of the URL model: each fold is judged by a model of the other labelled URLs."""

from pyspark.sql import functions as F

from quillmark.llm import url_filter
from quillmark.llm.url_labels import LABELLED

FOLDS = 4


def test_held_out_accuracy(spark):
    rows = spark.createDataFrame([(i, i % FOLDS, url, label) for i, (url, label) in enumerate(LABELLED)], "page_id long, fold int, url string, label int").cache()
    right = 0
    for fold in range(FOLDS):
        judged = url_filter.judge(rows.where(F.col("fold") == fold), rows.where(F.col("fold") != fold).select("url", "label"), rules=())
        right += judged.join(rows, "page_id").where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    print("held-out accuracy", right, "of", len(LABELLED))
    assert right >= 0.75 * len(LABELLED)
