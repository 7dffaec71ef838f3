"""Presence and absence of features in samples, in long form: one row for each feature that a sample has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CORE, CLOUD = 0.95, 0.05


def long_presence(wide: DataFrame, feature: str) -> DataFrame:
    """(feature, ``sample``) of the ones in a 0/1 matrix."""
    return wide.unpivot([feature], [c for c in wide.columns if c != feature], "sample", "value").where("value = 1").drop("value")


def features_per_sample(df: DataFrame, sample: str, feature: str) -> DataFrame:
    return df.groupBy(sample).agg(F.countDistinct(feature).alias("n_features"))


def _class(share: Column) -> Column:
    return F.when(share >= CORE, "core").when(share <= CLOUD, "cloud").otherwise("shell")


def _classes(pairs: DataFrame, sample: str, feature: str) -> DataFrame:
    total = pairs.select(sample).distinct().agg(F.count(F.lit(1)).alias("_all"))
    n = pairs.groupBy(feature).agg(F.count(F.lit(1)).alias("n_samples"))
    out = n.join(F.broadcast(total)).withColumn("frequency", F.col("n_samples") / F.col("_all")).drop("_all")
    return out.withColumn("class", _class(F.col("frequency")))


def _pairs(df: DataFrame, sample: str, feature: str) -> DataFrame:
    """Different pairs. Classes and counts share one exchange of them; the number of samples reads the input once more, for that column alone."""
    return df.select(sample, feature).where(F.col(sample).isNotNull() & F.col(feature).isNotNull()).distinct()


def feature_classes(df: DataFrame, sample: str, feature: str) -> DataFrame:
    """For each feature its samples, their share of all samples, and core, shell or cloud; rows with a null take no part."""
    return _classes(_pairs(df, sample, feature), sample, feature)


def sample_class_counts(df: DataFrame, sample: str, feature: str) -> DataFrame:
    """For each sample how many of its features are core, shell and cloud."""
    pairs = _pairs(df, sample, feature)
    named = pairs.join(_classes(pairs, sample, feature).select(feature, "class"), feature)
    one = lambda c: F.sum((F.col("class") == c).cast("long")).alias(c)
    return named.groupBy(sample).agg(one("core"), one("shell"), one("cloud"))


def prevalent(df: DataFrame, sample: str, feature: str, least: int = 10) -> DataFrame:
    """Rows of features that at least so many samples have."""
    kept = df.groupBy(feature).agg(F.countDistinct(sample).alias("n")).where(F.col("n") >= least)
    return df.join(kept.select(feature), feature, "left_semi")
