"""Batches: fixed sizes, greedy totals, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.sources.scratch import Tables

from .ranking import next_at_least, ordered_rank, placed, running_sums


def fixed(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch`` from 0 and ``batch_name`` (at least two digits), ``size`` rows each in order."""
    ranked = ordered_rank(df, order, name="_rank").withColumn("batch", ((F.col("_rank") - 1) / size).cast("long"))
    n = ranked.agg(F.max("batch").alias("_last"))
    width = F.greatest(F.lit(2), F.length(F.coalesce("_last", F.lit(0)).cast("string")))
    return ranked.join(F.broadcast(n)).withColumn("batch_name", F.concat(F.lit("batch_"), F.lpad(F.col("batch").cast("string"), width, "0"))).drop("_rank", "_last")


def greedy(groups: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """(``key``, ``size``, ``batch``): groups in order are gathered until a batch reaches ``target``, with the one that crosses it.

    The sum starts anew with each batch, which no window can express. But where a batch that
    starts at a group ends depends on that group alone: at the first group whose running sum
    reaches the sum before the start and the target together. So each group points at the one
    after that end, and the starts of batches are what the first group reaches by pointers.
    They are found by doubling: a table of pointers over 1, 2, 4, ... batches each, then from
    the widest to the narrowest every start found so far adds the one it points at. Pointers and
    steps are equality joins on places; their number is a logarithm of the number of batches.

    Groups are ordered by key, then size; a null size counts as 0, a null key comes first. With a
    target of 0 or less every group is a batch; sizes aren't negative.
    """
    tables = Tables(groups.sparkSession)
    rows = placed(groups.select(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size)), [F.col(key), F.col(size)], "_p")
    summed, (n, total) = tables.save_counted(running_sums(rows, "_p", {"_s": size}), "summed", F.sum(size))
    if n == 0 or target <= 0:
        return summed.select(key, size, F.col("_p").alias("batch"))
    asks = summed.select(F.col("_p").alias("_a"), (F.col("_s") - F.col(size) + target).alias("_s"))
    # Where no later group reaches the target, there is no next start; nor behind the last group.
    jump = next_at_least(summed.select("_s", F.col("_p").alias("_end")), asks, "_s", "_end").where("_end is not null").select("_a", (F.col("_end") + 1).alias("_b"))
    ladder = [tables.save(jump.where(F.col("_b") < n), "jump0")]
    while (1 << len(ladder)) * target <= (total or 0):
        last = ladder[-1]
        twice = last.join(last.select(F.col("_a").alias("_b"), F.col("_b").alias("_c")), "_b").select("_a", F.col("_c").alias("_b"))
        ladder.append(tables.save(twice, f"jump{len(ladder)}"))
    starts = groups.sparkSession.range(1).select(F.col("id").alias("_a"), F.lit(0).cast("long").alias("batch"))
    for k in reversed(range(len(ladder))):
        further = starts.join(ladder[k], "_a").select(F.col("_b").alias("_a"), (F.col("batch") + (1 << k)).alias("batch"))
        starts = tables.save(starts.unionByName(further), f"starts{k}")
    # A group belongs to the last start that isn't behind it: every group that is no start adds none.
    marked = summed.join(starts.withColumnRenamed("_a", "_p"), "_p", "left").withColumn("_new", F.when(F.col("batch").isNotNull() & (F.col("batch") > 0), 1).otherwise(0).cast("long"))
    return running_sums(marked.drop("batch"), "_p", {"batch": "_new"}).select(key, size, "batch")


def large_groups(df: DataFrame, key: str, least: int, flags: dict[str, str], first: dict[str, str] | None = None) -> DataFrame:
    """Groups of more than ``least`` rows, with the rows for which each SQL condition in ``flags`` holds.

    ``first`` (column to order) adds what a column holds in the group's first row by that order.
    """
    sums = [F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0)).alias(name) for name, c in flags.items()]
    sums += [F.min_by(c, order).alias(c) for c, order in (first or {}).items()]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") > least)


def sliced(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows from ``start`` (counted from 0) up to ``end``, exclusive, in order."""
    return ordered_rank(df, order, name="_rank").where((F.col("_rank") > start) & (F.col("_rank") <= end)).drop("_rank")
