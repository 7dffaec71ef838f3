"""From a token to exactly one category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.text import has_token

PREVIEW = 25


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of some columns that there is."""
    for name in names:
        if name in df.columns:
            return name
    raise KeyError(f"none of {names} is a column")


def matching(df: DataFrame, column: str, token: str) -> DataFrame:
    """Categories that hold ``token`` as a whole word, with their rows."""
    return df.where(has_token(F.col(column), token)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def resolve(df: DataFrame, column: str, token: str) -> str:
    """The one category that matches; an error names what there is, or what matches."""
    found = matching(df, column, token).orderBy(column).limit(PREVIEW + 1).collect()
    if len(found) == 1:
        return found[0][0]
    if found:
        raise ValueError(f"{token!r} fits several categories: " + ", ".join(f"{r[0]} ({r[1]})" for r in found[:PREVIEW]))
    there = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(PREVIEW).collect()]
    raise ValueError(f"{token!r} fits no category; there are {there}")


def resolve_pair(df: DataFrame, column: str, first: str, second: str) -> tuple[str, str]:
    """Two tokens, which must name different categories."""
    a, b = resolve(df, column, first), resolve(df, column, second)
    if a == b:
        raise ValueError(f"{first!r} and {second!r} both name {a!r}")
    return a, b
