"""Leakage-free splits, labels and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import seeded, shuffled_rank

TRAIN, VALIDATE = 0.7, 0.1
NAMES = ("train", "validate", "evaluate")


def with_splits(df: DataFrame, id: str, seed: int = 1, name: str = "train_val_eval") -> DataFrame:
    """Adds the split of each row's sample: 70 % train, 10 % validate, the rest evaluate, of the different samples.

    Fractions are cut in double arithmetic, as a list slice would: 62 of 90 train.
    """
    ids = df.select(id).where(F.col(id).isNotNull()).distinct()
    total = ids.agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_rank(ids, [], seeded(seed, id), [id], "_rank").join(F.broadcast(total))
    train = F.floor(F.lit(TRAIN) * F.col("_n"))
    validate = train + F.floor(F.lit(VALIDATE) * F.col("_n"))
    named = F.when(F.col("_rank") <= train, NAMES[0]).when(F.col("_rank") <= validate, NAMES[1]).otherwise(NAMES[2])
    return df.join(ranked.select(id, named.alias(name)), id)


def split_counts(df: DataFrame, id: str, label: str, split: str = "train_val_eval") -> DataFrame:
    """Different samples with a label in each split."""
    return df.where(F.col(label).isNotNull()).groupBy(split).agg(F.countDistinct(id).alias("n"))


def pair_label(df: DataFrame, column: str, first: str, second: str, name: str) -> DataFrame:
    """Rows of two categories; 1 for the first one."""
    return df.where(F.col(column).isin(first, second)).withColumn(name, (F.col(column) == first).cast("int"))


def pruned(df: DataFrame, id: str, present: DataFrame, required: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is present, and the different ids that are not; ``required`` makes it an error if none is present."""
    there = present.select(id).distinct()
    kept = df.join(there, id, "left_semi")
    if required and kept.isEmpty():
        raise ValueError(f"no {id} is present")
    return kept, df.select(id).where(F.col(id).isNotNull()).distinct().join(there, id, "left_anti")


def helper_free(columns: list[str], helpers: set[str]) -> list[str]:
    """Columns that are neither keys nor splits: the labels of a sheet."""
    return [c for c in columns if c not in helpers]


def smoke_sample(df: DataFrame, id: str, split: str = "train_val_eval", n: int = 10) -> DataFrame:
    """The first n training samples, used for validation as well."""
    some = df.where(F.col(split) == NAMES[0]).orderBy(id).limit(n)
    return some.unionByName(some.withColumn(split, F.lit(NAMES[1])))


def steps(n: int, batch: int, accumulate: int, epochs: int, warm: float) -> dict[str, int]:
    """Optimiser steps of a training run."""
    per_epoch = max(1, -(-n // batch) // accumulate)
    return {"steps_per_epoch": per_epoch, "total_steps": per_epoch * epochs, "warmup_steps": int(warm * per_epoch * epochs)}
