"""Each group against a pooled comparator: z tests with a correction for their number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from cohortloom.functions.stats import erfc

from .reconcile import constant_mapped
from .rollup import argmax_rows, ordered

Z_CRITICAL = 1.96


def z_tests(df: DataFrame, group: str, mean: str, sd: str, n: str, kind: str) -> DataFrame:
    """Groups of kind 1 against all of larger kinds pooled; rows without spread or repeats take no part.

    Tails are right to about 15 of their digits however small they are. Rows come in the order
    of their corrected p-values.
    """
    rows = df.na.drop(subset=[group, mean, sd, n, kind]).where((F.col(n) > 1) & (F.col(sd) > 0))
    rows = rows.withColumn("_v", F.col(sd) * F.col(sd) / F.col(n))
    w = F.col(n).cast("double")
    rest = rows.where(F.col(kind) > 1).agg(F.sum(w).alias("_w"), F.sum(w * F.col(mean)).alias("_wx"), F.sum(w * w * F.col("_v")).alias("_wwv")).where("_w > 0")
    rest = rest.select((F.col("_wx") / F.col("_w")).alias("rest_mean"), (F.col("_wwv") / (F.col("_w") * F.col("_w"))).alias("rest_var"))
    targets = rows.where(F.col(kind) == 1)
    m = targets.agg(F.count(F.lit(1)).alias("_m"))
    out = targets.join(F.broadcast(rest)).join(F.broadcast(m))  # one row each
    diff, se = F.col(mean) - F.col("rest_mean"), F.sqrt(F.col("_v") + F.col("rest_var"))
    out = out.withColumn("difference", diff).withColumn("se", se)
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("difference") / F.col("se")))
    x = F.abs(F.col("z")) / F.sqrt(F.lit(2.0))
    out = out.withColumn("p", erfc(x))
    out = out.withColumn("p_bonferroni", F.least(F.col("p") * F.col("_m"), F.lit(1.0)))
    half = Z_CRITICAL * F.col("se")
    out = out.withColumn("ci_low", F.when(F.col("se") > 0, F.col("difference") - half)).withColumn("ci_high", F.when(F.col("se") > 0, F.col("difference") + half))
    out = out.select(group, F.col(mean).alias("target_mean"), "rest_mean", "difference", F.sqrt("_v").alias("se_target"), "se", "z", "p", "p_bonferroni", "ci_low", "ci_high")
    return out.orderBy(F.asc_nulls_last("p_bonferroni"), group)


@dataclass(frozen=True)
class Summary:
    """Columns of a table with one row for each run: the group and its kind, sizes, and how many lineages were in it."""

    group: str
    kind: str
    lineages: str
    samples: str
    size: str


def prepared(df: DataFrame, c: Summary, kinds: list[str], columns: list[str], common: str, label: str, mapping: dict[str, str], name: str = "major", ties: str | None = None) -> DataFrame:
    """Runs of some kinds as the tests take them.

    The common group, which has many rows, takes its size from its samples. ``name`` is what
    ``mapping`` has for a group. Of runs of one group with equally many lineages the one with
    most samples stays (then the first by ``ties``). Rows come by lineages, then largest
    first, and those of the common group are called ``label 1``, ``label 2`` ... in that order.
    """
    rows = df.where(F.col(c.kind).isin(*kinds)).select(*columns)
    rows = rows.withColumn(c.size, F.when(F.col(c.group) == common, F.col(c.samples)).otherwise(F.col(c.size)))
    best = argmax_rows(constant_mapped(rows, c.group, mapping, name), [c.group, c.lineages], c.samples, ties or c.size)
    # The common group has one row left for each number of lineages.
    place = F.row_number().over(Window.partitionBy(c.group).orderBy(F.asc_nulls_last(c.lineages), F.desc_nulls_last(c.size)))
    out = best.withColumn(c.group, F.when(F.col(c.group) == common, F.concat_ws(" ", F.lit(label), place.cast("string"))).otherwise(F.col(c.group)))
    return ordered(out, **{c.lineages: True, c.size: False})


def error_bars(tests: DataFrame) -> DataFrame:
    """Half widths around the difference, never negative."""
    return tests.withColumn("lower", F.greatest(F.lit(0.0), F.col("difference") - F.col("ci_low"))).withColumn("upper", F.greatest(F.lit(0.0), F.col("ci_high") - F.col("difference")))
