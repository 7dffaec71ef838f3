"""Statistics that have no built-in expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: W. J. Cody's rational approximations of the error function (Mathematics of Computation 23, 1969),
#: for x up to 0.46875, up to 4, and beyond; numerators and denominators from the highest power down.
_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
_ROOT = 5.6418958354775628695e-1  # one over the square root of pi


def _fraction(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    up, down = F.lit(0.0), F.lit(0.0)
    for a, b in zip(*parts, strict=True):
        up, down = up * x + a, down * x + b
    return up / down


def erfc(x: Column) -> Column:
    """Complementary error function of ``x >= 0`` in column expressions, to about 15 digits of the result, however small."""
    square = x * x
    near = 1 - x * _fraction(square, _NEAR)
    # exp(-x * x) from a square that has few digits, and the rest, so that no digits are lost.
    cut = F.floor(x * 16) / 16.0
    tail = F.exp(-cut * cut) * F.exp(-(x - cut) * (x + cut))
    over = F.when(x > 0, 1 / square).otherwise(F.lit(0.0))
    far = tail * (_ROOT - over * _fraction(over, _FAR)) / F.when(x > 0, x).otherwise(F.lit(1.0))
    return F.when(x <= 0.46875, near).when(x <= 4, tail * _fraction(x, _MIDDLE)).when(x > 26.7, F.lit(0.0)).otherwise(far)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """Larger over smaller: infinite if one side is empty, 0 if both are."""
    small, large = F.least(a, b), F.greatest(a, b)
    return F.when(large == 0, 0.0).when(small == 0, float("inf")).otherwise(large / small)


def ratio_bounds(r: float) -> tuple[float, float]:
    return (0.0, float("inf")) if r <= 0 else (1 / r, r)


def bounds_of(r: Column) -> tuple[Column, Column]:
    """The same for a column of ratios."""
    return F.when(r <= 0, 0.0).otherwise(F.try_divide(F.lit(1.0), r)), F.when(r <= 0, float("inf")).otherwise(r.cast("double"))


def histogram_bin(x: Column, low: float, step: float, bins: int) -> Column:
    """Bin from 0; the last bin is closed on the right; outside null."""
    high = low + step * bins
    return F.when((x >= low) & (x < high), F.floor((x - low) / step)).when(x == high, F.lit(bins - 1)).cast("int")
