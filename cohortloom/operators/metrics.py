"""Metrics of a binary classifier, from counts by distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.stats import sigmoid

from .ranking import running_sums

IGNORE = -100


def binary_metrics(df: DataFrame, logit: str, label: str, ignore: int = IGNORE, digits: int | None = None) -> DataFrame:
    """One row: accuracy, area under the ROC curve, average precision, F1 and the number of rows.

    Rows collapse to one for each distinct score first; the running sums go over those,
    rounded to ``digits`` if that is given, which bounds their number.
    """
    rows = df.where((F.col(label) != ignore) & F.col(logit).isNotNull()).select(F.col(logit).alias("s"), (F.col(label) == 1).cast("long").alias("y"))
    if digits is not None:
        rows = rows.withColumn("s", F.round("s", digits))
    by = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    by = running_sums(by.withColumn("down", -F.col("s")), "down", {"tp": "pos", "fp": "neg"}).withColumn("hit", (sigmoid(F.col("s")) >= 0.5).cast("long"))
    sums = by.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("hit") * F.col("pos")).alias("tp"), F.sum(F.col("hit") * F.col("neg")).alias("fp"),
        # A positive beats the negatives below it, and half of those at its score.
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos")).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )
    p, n, tp, fp = (F.col(c).cast("double") for c in ("p", "n", "tp", "fp"))
    nan = F.lit(float("nan"))
    return sums.select(
        ((tp + n - fp) / (p + n)).alias("accuracy"),
        F.when((p > 0) & (n > 0), F.col("wins") / (p * n)).otherwise(nan).alias("auroc"),
        F.when(p > 0, F.col("precision") / p).otherwise(nan).alias("auprc"),
        F.when(2 * tp + fp + (p - tp) > 0, 2 * tp / (2 * tp + fp + (p - tp))).otherwise(0.0).alias("f1"),
        (F.col("p") + F.col("n")).cast("long").alias("n"),
    )
