"""Laboratory measurements: an operator, a number, perhaps units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Comparison operators that a measurement may have, the form of its number, and of what may follow after a slash.
OPERATORS = (">", "<", ">=", "<=", "=", "==")
_NUMBER, _OVER = r"\d*\.?\d+", r"/\d+"
NUMBER = rf"^{_NUMBER}(?:{_OVER}.*)?$"
#: White space as text is split by in the source of the data: the Unicode kinds as well, and the information separators.
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def parts(c: Column) -> Column:
    return F.split(F.regexp_replace(c, f"^[{_SPACE}]+|[{_SPACE}]+$", ""), f"[{_SPACE}]+")


def reject_reason(c: Column) -> Column:
    """Why a measurement can't be read; null for readable and for null ones."""
    p = parts(c)
    op, number = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(number.isNull(), "parts")
        .when(~op.isin(*OPERATORS), "operator")
        .when(~number.rlike(NUMBER), "number")
    )


#: The two parts of a readable measurement, as one pattern, which keeps expressions over them short.
_READ = rf"(?s)^[{_SPACE}]*({'|'.join(sorted(OPERATORS, key=len, reverse=True))})[{_SPACE}]+({_NUMBER})(?:{_OVER}[^{_SPACE}]*)?(?:[{_SPACE}].*)?$"


def operator(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _READ, 1), F.lit(""))


def number(c: Column) -> Column:
    """The number before any slash."""
    return F.nullif(F.regexp_extract(c, _READ, 2), F.lit("")).try_cast("double")


def log_value(value: Column, op: Column) -> Column:
    """log10, one less below and one more above a detection limit; minus infinity for 0."""
    log = F.when(value == 0, F.lit(float("-inf"))).otherwise(F.log10(value))
    return F.when(op == "<", log - 1).when(op == ">", log + 1).otherwise(log)


def binary_phenotype(c: Column) -> Column:
    """1 resistant, 0 susceptible, else null; case does not matter, white space does."""
    return F.when(F.lower(c) == "resistant", 1).when(F.lower(c) == "susceptible", 0)


def training_label(mean: Column) -> Column:
    """Means of repeated labels are truncated: 0.5 becomes 0."""
    return mean.cast("int")


def opacity(total: Column, tested: Column, percent: Column) -> Column:
    """How firmly a bar is drawn: not at all with fewer than 100 samples or tests."""
    return F.when((total < 100) | (tested < 100), 0.0).otherwise(F.least(F.lit(1.0), percent / 100))
