"""Exact ranks and running sums without a task that sees a whole group.

A window over a group, or over everything, sorts it in one task. Here rows are
dealt by range over the whole order into as many slices as the session has
partitions, sorted inside their slice, and written: a row's place is its place
in the slice and the number of rows in lower slices. The latter are one row a
slice, whatever the input. A rank in a group is the distance from the group's
first place. Rows that are alike in the order are dealt by a hash of all their
columns, so that ties fill no slice either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.sources.scratch import Tables

_BITS = 33  # of the number that Spark gives a row in its partition


def seeded(seed: int, *ids: str) -> Column:
    """A reproducible shuffle key: it depends on the seed and the ids, not on partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def _sliced(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows as a table, with ``_slice`` and, by the order in it, ``_at`` from 0."""
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    by = [*order, spread]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    kept = Tables(df.sparkSession).save(dealt, "dealt")
    return kept.withColumn("_slice", F.shiftright("_m", _BITS)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_m")


def _lower(each: DataFrame, *sums: str) -> DataFrame:
    """One row for each slice: the sums over lower slices."""
    below = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_slice", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in sums])


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place from 0 in an order over all rows; nulls come first unless the order says otherwise."""
    rows = _sliced(df, order)
    starts = _lower(rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")), "_n")
    return rows.join(F.broadcast(starts), "_slice").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + F.col("_n")).alias(name))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank from 1 in each group; null keys are a group."""
    if not keys:
        return placed(df, order, "_place").withColumn(name, F.col("_place") + 1).drop("_place")
    rows = placed(df, [*map(F.col, keys), *order], "_place")
    first = rows.groupBy(*keys).agg(F.min("_place").alias("_first"))
    met = rows.alias("_l").join(first.alias("_r"), [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys])
    return met.select(*[F.col(f"_l.`{c}`") for c in df.columns], (F.col("_place") - F.col("_first") + 1).alias(name))


def shuffled_rank(df: DataFrame, keys: list[str], shuffle: Column, ties: list[str], name: str = "rank") -> DataFrame:
    """Rank from 1 in each group by a shuffle key."""
    return rank_within(df.withColumn("_shuffle", shuffle), keys, [F.col("_shuffle"), *map(F.col, ties)], name).drop("_shuffle")


def ordered_rank(df: DataFrame, order: str, ties: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Rank from 1 by a column."""
    return rank_within(df, [], [F.col(order), *map(F.col, ties)], name)


def running_sums(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds to each row the sums (new name to column) over all rows up to it, by a column without repeated values."""
    rows = _sliced(df, [F.col(order)])
    starts = _lower(rows.groupBy("_slice").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()]), *[f"_s_{name}" for name in sums])
    up = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns({f"_i_{name}": F.sum(c).over(up) for name, c in sums.items()})
    return inside.join(F.broadcast(starts), "_slice").select(*df.columns, *[(F.col(f"_i_{name}") + F.col(f"_s_{name}")).alias(name) for name in sums])


def next_at_least(marks: DataFrame, asks: DataFrame, value: str, mark: str) -> DataFrame:
    """``asks`` with the ``mark`` of the first row of ``marks`` whose value is no less than their own; null if there is none.

    Marks and asks are dealt together by value; of a slice only its first mark is of use to lower ones. Among
    marks of one value the smallest counts.
    """
    names = asks.columns
    both = asks.select(F.struct(*names).alias("_ask"), F.col(value).alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(dict(marks.dtypes)[mark]).alias("_mark"))
    both = both.unionByName(marks.groupBy(F.col(value).alias("_v")).agg(F.min(mark).alias("_mark")).select(F.lit(None).cast(both.schema["_ask"].dataType).alias("_ask"), "_v", F.lit(1).alias("_kind"), "_mark"))
    rows = _sliced(both, [F.col("_v"), F.col("_kind")])
    ahead = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy("_slice").agg(F.min_by("_mark", F.when(F.col("_kind") == 1, F.col("_at"))).alias("_head"))
    firsts = firsts.select("_slice", F.first("_head", ignorenulls=True).over(later).alias("_later"))
    found = rows.withColumn("_own", F.first("_mark", ignorenulls=True).over(ahead)).where("_kind = 0").join(F.broadcast(firsts), "_slice")
    return found.select("_ask.*", F.coalesce("_own", "_later").alias(mark))
