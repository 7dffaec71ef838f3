"""Cohorts: filter funnels, routing into threads, ratio-balanced sampling with an audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.functions.stats import ratio as larger_to_smaller
from cohortloom.functions.text import mentions

from .ranking import seeded, shuffled_rank

SEED = 42


def funnel_counts(df: DataFrame, stages: list[tuple[str, Column | None]]) -> DataFrame:
    """(``stage``, ``step``, ``n``): rows left after each filter, in one pass; a stage without a condition keeps all."""
    passed, sums = F.lit(True), []
    for k, (_, condition) in enumerate(stages):
        if condition is not None:
            passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.coalesce(F.sum(passed.cast("long")), F.lit(0)).alias(f"s{k}"))
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.col(f"s{k}").alias("n")) for k, (name, _) in enumerate(stages)])
    return df.agg(*sums).select(F.explode(rows).alias("p")).select("p.*")


def funnel(df: DataFrame, stages: list[tuple[str, Column | None]]) -> DataFrame:
    """The rows that pass every stage."""
    for _, condition in stages:
        df = df if condition is None else df.where(condition)
    return df


def flagged_only(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true. A null flag is an error, so that no row is lost for want of knowledge."""
    c = F.col(flag)
    return df.where(F.when(c.isNull(), F.raise_error(F.lit(f"{flag} is null")).cast("boolean")).otherwise(c.cast("boolean")))


def in_group_or_none(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one group together with those of no group."""
    return df.where(F.col(column).isNull() | (F.col(column) == value))


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, repeated ones included, matched by column name; an error without any part."""
    if not parts:
        raise ValueError("nothing to unite")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def routed(df: DataFrame, study: str, name: str = "thread") -> DataFrame:
    """Adds the thread: AMR before Surveillance; NA where the study is unknown; null where none fits."""
    c = F.col(study)
    return df.withColumn(name, F.when(mentions(c, "amr"), "AMR").when(mentions(c, "surveillance"), "Surveillance").when(c.isNull(), "NA"))


@dataclass(frozen=True)
class Stratum:
    """What balanced sampling needs to know about a table."""

    strata: tuple[str, ...]
    category: str
    first: str
    second: str
    id: str
    seed: int = SEED


def stratum_counts(df: DataFrame, s: Stratum) -> DataFrame:
    """Rows of both classes in each stratum; a null in the last column of the strata takes no part."""
    n = lambda v: F.sum((F.col(s.category) == v).cast("long"))
    return df.where(F.col(s.strata[-1]).isNotNull()).groupBy(*s.strata).agg(F.coalesce(n(s.first), F.lit(0)).alias("n1"), F.coalesce(n(s.second), F.lit(0)).alias("n2"))


def audited(counts: DataFrame, target: Column | float) -> DataFrame:
    """Adds what a ratio does to each stratum: ``ratio``, ``action``, and rows sampled of both classes.

    Without a ratio (0 or less) all is kept. With one, strata that lack a class go, those
    within the ratio stay, and of the rest the larger class is cut to ``floor(ratio * smaller)``.
    Of equal classes the second one counts as the smaller.
    """
    t = target if isinstance(target, Column) else F.lit(float(target))
    a, b = F.col("n1"), F.col("n2")
    r = larger_to_smaller(a, b)
    small = F.least(a, b)
    cut = F.least(F.floor(t * small).cast("long"), F.greatest(a, b))
    action = F.when(t <= 0, "accepted_all_no_ratio").when(small == 0, F.lit(None).cast("string")).when((r >= 1 / t) & (r <= t), "accepted_all").otherwise("country_sampled")
    out = counts.withColumn("ratio", r).withColumn("action", action).where("action is not null")
    sampled = F.col("action") == "country_sampled"
    return out.withColumn("sampled1", F.when(sampled & (a >= b), cut).otherwise(a)).withColumn("sampled2", F.when(sampled & (a < b), cut).otherwise(b))


def balanced(df: DataFrame, s: Stratum, target: float) -> DataFrame:
    """The rows that stay, chosen by a seeded shuffle that no partitioning changes."""
    audit = audited(stratum_counts(df, s), target).select(*[F.col(k).alias(f"_{k}") for k in s.strata], "sampled1", "sampled2", "action")
    ranked = shuffled_rank(df.where(F.col(s.strata[-1]).isNotNull()), [*s.strata, s.category], seeded(s.seed, s.id), [s.id], "_rank")
    # One row for each stratum; Spark broadcasts it if it is small, else joins by key.
    out = ranked.join(audit, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in s.strata])
    quota = F.when(F.col(s.category) == s.first, F.col("sampled1")).when(F.col(s.category) == s.second, F.col("sampled2"))
    keep = (F.col("action") != "country_sampled") | (F.col("_rank") <= quota)
    return out.where(keep).select(*df.columns)


def ratio_sweep(df: DataFrame, s: Stratum, ratios: tuple[float, ...] = (1.0, 2.0, 2.5, 3.0)) -> DataFrame:
    """What each ratio would leave over all strata; the strata are counted once."""
    counts = stratum_counts(df, s).withColumn("target", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    out = audited(counts, F.col("target"))
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n_strata"), F.sum("sampled1").cast("long").alias("n1"), F.sum("sampled2").cast("long").alias("n2"), F.sum(F.col("sampled1") + F.col("sampled2")).cast("long").alias("n"))


def swept(df: DataFrame, s: Stratum, ratios: tuple[float, ...] = (1.0, 2.0, 2.5, 3.0), chosen: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """What each ratio would leave, and the rows that the chosen one leaves."""
    return ratio_sweep(df, s, ratios), balanced(df, s, chosen)


def audit_totals(audit: DataFrame) -> DataFrame:
    out = audit.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n1", "n2", "sampled1", "sampled2")])
    return out.withColumn("ratio", larger_to_smaller(F.col("sampled1"), F.col("sampled2")))


def detailed_report(audit: DataFrame, place: str) -> DataFrame:
    """The audit, most initial rows first, with names cut at 28 characters."""
    out = audit.withColumn("label", F.substring(place, 1, 28)).withColumn("n", F.col("n1") + F.col("n2"))
    return out.select("label", "n1", "n2", "n", "sampled1", "sampled2", "action").orderBy(F.desc("n"), "label")


def before_after(before: DataFrame, after: DataFrame, place: str, category: str, first: str, second: str) -> DataFrame:
    """Rows of both classes by place before and after, places of either side."""
    n = lambda v: F.sum((F.col(category) == v).cast("long"))
    side = lambda df, x: df.where(F.col(place).isNotNull()).groupBy(place).agg(n(first).alias(f"{x}1"), n(second).alias(f"{x}2"))
    out = side(before, "init").join(side(after, "final"), place, "full_outer").na.fill(0)
    return out.withColumn("ratio", larger_to_smaller(F.col("final1"), F.col("final2")))


def sample_n(df: DataFrame, id: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows, or all there are, by a seeded shuffle; an error if there is none."""
    if df.isEmpty():
        raise ValueError("nothing to sample from")
    return df.orderBy(seeded(seed, id), id).limit(n)


def first_k(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group by an order column; Spark keeps k rows per group and task before it shuffles."""
    w = Window.partitionBy(group).orderBy(order)
    return df.where(F.col(group).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
