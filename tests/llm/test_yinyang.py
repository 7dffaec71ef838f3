"""Clustering against plain Lloyd rounds in Python integers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import yinyang

KIND = "vec_id bigint, embedding array<float>"


def plain(rows, k, rounds, dim):
    """The contract, one vector at a time."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64 * max(-(2.0**21), min(2.0**21, float(np.float32(x)))))) for x in v]))
    starts = sorted((x for x in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [list(x) for _, x in starts]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for n in range(len(cs)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == n]
            if mine:
                cs[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(d for *_, d in out)
    return sorted(map(repr, ((i, c, d, sum(y for _, o, y in out if o == c), total, hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in out)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(6, dim))
    return [(k, [float(np.float32(x)) for x in means[k % 6] + rng.normal(size=dim) * 0.4]) for k in range(n)]


def test_equals_plain_rounds(spark):
    rows = vectors(300, 64)
    want = plain(rows, 16, 3, 64)
    for parts in (1, 3, 17):
        assert got(yinyang.clusters(spark.createDataFrame(rows, KIND).repartition(parts))) == want


@pytest.mark.parametrize(("k", "rounds", "groups"), [(1, 2, 4), (5, 0, 2), (7, 8, 3), (40, 5, 1)])
def test_other_sizes(spark, k, rounds, groups):
    rows = vectors(60, 3, seed=k)
    assert got(yinyang.clusters(spark.createDataFrame(rows, KIND), k=k, rounds=rounds, groups=groups, dim=3)) == plain(rows, k, rounds, 3)


def test_ties_repeats_and_broken_vectors(spark):
    rng = random.Random(4)
    grid = [(k, [float(rng.randrange(3)) / 64 for _ in range(4)]) for k in range(80)]
    odd = [(90, None), (91, []), (92, [1.0, 2.0, 3.0]), (93, [1.0, None, 0.0, 0.0]), (94, [1.0, float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0, 0.0])]
    odd += [(None, [0.5, 0.5, 0.5, 0.5]), (None, None), (96, [3e38, -3e38, 0.0, 0.0]), (3, grid[3][1]), (3, [2.0, 2.0, 2.0, 2.0])]
    rows = grid + odd
    df = spark.createDataFrame(rows, KIND)
    want = plain(rows, 9, 4, 4)
    assert got(yinyang.clusters(df, k=9, rounds=4, groups=3, dim=4)) == want
    clash = df.select("*", *[F.lit("mine").alias(n) for n in ("x", "cluster", "upper", "lower", "distance")])
    assert got(yinyang.clusters(clash, k=9, rounds=4, groups=3, dim=4)) == want
    assert yinyang.clusters(df.limit(0)).collect() == [] and len(yinyang.clusters(df.limit(0)).columns) == 6
    assert yinyang.clusters(df.where("vec_id in (90, 91)")).collect() == []


def test_double_vectors_and_text_ids(spark):
    rows = [(f"v{k}", v) for k, v in vectors(50, 64, seed=9)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert got(yinyang.clusters(df)) == plain(rows, 16, 3, 64)


def test_filters_leave_most_distances_out():
    """After the first round, most exact distances aren't taken, and nothing changes by that."""
    rng = np.random.default_rng(2)
    means = rng.integers(-200, 200, size=(64, 16))
    x = means[rng.integers(0, 64, 4000)] + rng.integers(-8, 9, size=(4000, 16))
    c = means + rng.integers(-8, 9, size=means.shape)
    of = yinyang.grouped(c, 8)
    own, upper, lower = yinyang.Step(c, of).first(x)
    for _ in range(4):
        was = c.copy()
        for n in range(64):
            if (own == n).any():
                c[n] = x[own == n].sum(0) // (own == n).sum()
        step = yinyang.Step(c, of, yinyang._up(((c - was) ** 2).sum(1)) * (c != was).any(1))
        own, upper, lower = step.again(x, own, upper, lower)
        d = yinyang.squared(x, c)
        assert (own == d.argmin(1)).all() and step.scanned < 0.2 * d.size
        d_own = np.sqrt(d[np.arange(len(x)), own])
        assert (upper >= d_own).all()
        d[np.arange(len(x)), own] = np.iinfo(np.int64).max
        assert all((lower[:, g] <= np.sqrt(d[:, of == g].min(1))).all() for g in range(int(of.max()) + 1))


def test_large_components_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [3, 4]])
    assert yinyang.squared(x, np.array([[-(1 << 27), 1 << 27], [0, 0]])).tolist() == [[1 << 57, 1 << 55], [(2 << 54) + 2 * (1 << 27) * (3 - 4) + 25, 25]]
