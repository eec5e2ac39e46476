"""Evaluation metrics (M5, M6) as one aggregate over (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.functions.safe import r6, safe_div


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 of the positive class and accuracy, in one pass."""
    y, p = F.col(label), F.col(prediction)
    counts = df.agg(
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y != 1) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p != 1)).cast("bigint").alias("fn"),
        F.count_if((y != 1) & (p != 1)).cast("bigint").alias("tn"),
    )
    c = F.col
    precision = safe_div(c("tp"), c("tp") + c("fp"))
    recall = safe_div(c("tp"), c("tp") + c("fn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        r6(precision).alias("precision"),
        r6(recall).alias("recall"),
        r6(safe_div(2 * precision * recall, precision + recall)).alias("f1"),
        r6(safe_div(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))).alias("accuracy"),
    )
