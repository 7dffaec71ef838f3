"""Two-way counts in long form: wide tables are a matter of presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of each pair of values; rows with a null on either side are left out."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def wide_crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """The same with a column for each of ``values``, 0 where there is none."""
    there = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return there.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def row_percent(df: DataFrame, row: str, column: str) -> DataFrame:
    n = crosstab(df, row, column)
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def frequent(df: DataFrame, column: str, percent: float) -> DataFrame:
    """Values that make up at least ``percent`` of all rows, with their share."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent")).where(F.col("percent") >= percent)


def share_crosstab(df: DataFrame, row: str, column: str, percent: float) -> DataFrame:
    """Crosstab of the rows whose value is frequent enough."""
    return crosstab(df.join(frequent(df, row, percent).select(row), row, "left_semi"), row, column)


def top_or_other(df: DataFrame, column: str, k: int, other: str | None = "other", name: str | None = None) -> DataFrame:
    """Relabels all but the k most frequent values (ties: the smaller value stays); nulls become ``other`` too."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
    top = top.select(F.col(column).alias("_top"))
    label = F.when(F.col("_top").isNotNull(), F.col(column)).otherwise(F.lit(other).cast("string"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(name or column, label).drop("_top")


def class_ratio(df: DataFrame, group: str, column: str, first: str, second: str) -> DataFrame:
    """For each group the rows of two classes, their ratio (infinite without the second) and their total."""
    n = lambda v: F.sum((F.col(column) == v).cast("long"))
    out = df.where(F.col(group).isNotNull() & F.col(column).isin(first, second)).groupBy(group).agg(n(first).alias("n_first"), n(second).alias("n_second"))
    a, b = F.col("n_first"), F.col("n_second")
    return out.withColumn("ratio", F.when(b == 0, float("inf")).otherwise(F.try_divide(a, b))).withColumn("total", a + b)


def extreme(ratios: DataFrame, limit: float = 10.0) -> DataFrame:
    return ratios.where((F.col("ratio") > limit) | (F.col("ratio") < 1 / limit))


def breakdown(df: DataFrame, category: str, column: str, first: str, second: str, top: int | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Categories with the rows of two classes, ordered by the rows of all classes."""
    rows = df.where(F.col(category).isNotNull() & F.col(column).isNotNull())
    if exclude:
        rows = rows.where(~F.col(category).isin(*exclude))
    n = lambda v: F.sum((F.col(column) == v).cast("long"))
    out = rows.groupBy(category).agg(n(first).alias("n_first"), n(second).alias("n_second"), F.count(F.lit(1)).alias("n_all")).orderBy(F.desc("n_all"), category)
    return out if top is None else out.limit(top)


def overall_ratio(df: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """The ratio of two classes over all rows, and its decimal logarithm."""
    n = lambda v: F.coalesce(F.sum((F.col(column) == v).cast("long")), F.lit(0))
    out = df.agg(n(first).alias("n_first"), n(second).alias("n_second"))
    ratio = F.when(F.col("n_second") == 0, float("inf")).otherwise(F.try_divide("n_first", "n_second"))
    return out.withColumn("ratio", ratio).withColumn("log10_ratio", F.log10("ratio"))


def ends(ratios: DataFrame, order: str, ties: str, k: int = 10) -> DataFrame:
    """The k largest and the k smallest by a column, marked as such."""
    top = ratios.orderBy(F.desc(order), ties).limit(k).withColumn("end", F.lit("head"))
    return top.unionByName(ratios.orderBy(F.col(order), F.desc(ties)).limit(k).withColumn("end", F.lit("tail")))
