"""Counts, group filters, roll-ups, pivots and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(df: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    """Rows for each value, most frequent first; ties by value."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def having_count(df: DataFrame, column: str, least: int | Column, strict: bool = False) -> DataFrame:
    """Rows whose value of ``column`` has at least (``strict``: more than) ``least`` rows."""
    n = F.col("n")
    kept = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(n > least if strict else n >= least)
    return df.join(kept.select(column), column, "left_semi")


def dropped_counts(df: DataFrame, column: str, least: int, report: int = 500) -> DataFrame:
    """Values that ``having_count`` drops although they have more than ``report`` rows, most frequent first."""
    return value_counts(df, column).where((F.col("n") < least) & (F.col("n") > report)).orderBy(F.desc("n"), column)


def test_stats(df: DataFrame, by: str | list[str], phenotype: str) -> DataFrame:
    """Totals by phenotype and percentages of the three that count; 0 where none does."""
    p = F.lower(F.col(phenotype))
    one = lambda name: F.sum(F.when(p == name, 1).otherwise(0)).cast("long")
    out = df.groupBy(*[by] if isinstance(by, str) else by).agg(
        F.count(F.lit(1)).alias("n_total"), one("resistant").alias("n_r"), one("susceptible").alias("n_s"), one("intermediate").alias("n_i")
    )
    known = F.col("n_r") + F.col("n_s") + F.col("n_i")
    share = lambda c: F.when(known > 0, 100.0 * F.col(c) / known).otherwise(0.0)
    return out.withColumn("n_other", F.col("n_total") - known).withColumn("r_percent", share("n_r")).withColumn("s_percent", share("n_s"))


def first_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the first value of each column that is not null, by an explicit order; null keys go."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def pivot_mean(df: DataFrame, key: str, column: str, value: str, values: list[str] | None = None) -> DataFrame:
    """Means by key and column, one column each; keys and columns without any value are left out."""
    there = df.where(F.col(value).isNotNull())
    if values is None:
        # The number of result columns bounds this list.
        values = [r[0] for r in there.select(column).distinct().orderBy(column).collect()]
    return there.groupBy(key).pivot(column, values).agg(F.avg(value))


def long_mean(df: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """The same in long form."""
    return df.where(F.col(value).isNotNull()).groupBy(key, column).agg(F.avg(value).alias("mean"))


def sparsity(df: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Cells, and null cells, of the pivot, without making it."""
    there = df.where(F.col(value).isNotNull())
    cells = there.select(key, column).distinct().agg(F.count(F.lit(1)).alias("filled"))
    sides = there.agg(F.countDistinct(key).alias("n_keys"), F.countDistinct(column).alias("n_columns"))
    out = sides.join(F.broadcast(cells)).withColumn("n_cells", F.col("n_keys") * F.col("n_columns"))
    nulls = F.col("n_cells") - F.col("filled")
    return out.select("n_keys", "n_columns", "n_cells", nulls.alias("n_null"), F.when(F.col("n_cells") > 0, nulls / F.col("n_cells")).alias("sparsity"))


def profile(df: DataFrame, facets: list[str], top: int = 10) -> DataFrame:
    """The most frequent values of each facet with their share of all rows, nulls as a value of their own.

    One pass: rows are turned into (facet, value) pairs and counted together.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])).alias("p")
    counts = df.select(pairs).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))
    # Null comes first, so that one rank with a limit, cut in each task before anything is shuffled, serves all.
    facet = Window.partitionBy("facet")
    place = F.row_number().over(facet.orderBy(F.col("value").isNotNull(), F.desc("n"), "value"))
    best = counts.withColumn("place", place).where(F.col("place") <= top + 1)
    nulls = F.max(F.col("value").isNull().cast("int")).over(facet)  # over top + 1 rows
    known = best.withColumn("nulls", nulls).where(F.col("value").isNull() | (F.col("place") - F.col("nulls") <= top)).drop("place", "nulls")
    total = counts.groupBy("facet").agg(F.sum("n").alias("total"))  # one row for each facet
    out = known.join(F.broadcast(total), "facet")
    return out.select("facet", "value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def year_range(df: DataFrame, column: str) -> DataFrame:
    n = F.count(column)
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), n.alias("n_known"), F.when(F.count(F.lit(1)) > 0, 100.0 * n / F.count(F.lit(1))).alias("percent_known"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(``column``, ``n_null``) in one pass."""
    columns = columns or df.columns
    wide = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n_null")) for c in columns])).alias("p")).select("p.*")


def argmax_rows(df: DataFrame, key: str | list[str], metric: str, ties: str) -> DataFrame:
    """For each key (or several together) the row with the largest metric; of equal ones the first by ``ties``."""
    best = F.min_by(F.struct(*df.columns), F.struct((-F.col(metric)).alias("m"), F.col(ties).alias("t")))
    return df.where(F.col(metric).isNotNull()).groupBy(*[key] if isinstance(key, str) else key).agg(best.alias("_r")).select("_r.*")


def weighted_mean(df: DataFrame, value: str, weight: str, variance: str) -> DataFrame:
    """Mean by weights, and the variance of that mean."""
    x, w, v = F.col(value).cast("double"), F.col(weight).cast("double"), F.col(variance).cast("double")
    sums = df.agg(F.sum(w).alias("weight"), F.sum(w * x).alias("wx"), F.sum(w * w * v).alias("wwv"))
    return sums.select((F.col("wx") / F.col("weight")).alias("mean"), (F.col("wwv") / (F.col("weight") * F.col("weight"))).alias("var"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact numbers of different values."""
    return df.agg(*[F.countDistinct(c).alias(c) for c in columns])


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(``column``, ``n``, ``mean``, ``least``, ``most``) of numbers in one pass; nulls take no part, and of nothing the three are null."""
    sums = [f(F.col(f"`{c}`").cast("double")).alias(f"_{name}{k}") for k, c in enumerate(columns) for name, f in (("n", F.count), ("mean", F.avg), ("least", F.min), ("most", F.max))]
    one = lambda k, c: F.struct(F.lit(c).alias("column"), *[F.col(f"_{name}{k}").alias(name) for name in ("n", "mean", "least", "most")])
    return df.agg(*sums).select(F.explode(F.array(*[one(k, c) for k, c in enumerate(columns)])).alias("p")).select("p.*")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``names`` (source to new name) in that order; names may hold any character. A KeyError tells of missing ones."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def ordered(df: DataFrame, **ascending: bool) -> DataFrame:
    """Sorted by several columns, each up (True) or down; nulls come last either way."""
    return df.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in ascending.items()])
