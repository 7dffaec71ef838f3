"""Centroid clustering by Lloyd's rounds with Yinyang bounds, exact in integers.

A vector's components become integers, so distances, means and ties are exact
and don't depend on how rows are dealt. Centroids are cut into groups once. A
vector carries an upper bound on the distance to its own centroid and, for each
group, one lower bound on the distances to the group's other centroids:

1. After a round the bounds move by how far centroids moved.
2. Global filter: if no lower bound reaches down to the upper one, nothing can
   have changed; the upper bound is made exact and asked once more.
3. Group filter: only groups whose lower bound reaches down are scanned, by
   exact distances to all their centroids.

Bounds are floats, rounded outwards, and a group is left out only if it is
farther for certain, so that equal distances always meet in an exact scan.

Each round reads and writes the vectors once; only the sums of each centroid
(``k`` times ``dim`` numbers, whatever the input) come to the driver, so a
cluster may hold any share of the rows.

Defined results: a vector that is null, has another length, or holds a null or a
number that isn't finite is left out; components saturate at 2**27 in integers
(2**21 before scaling); fewer vectors than ``k`` give as many centroids; vectors
with a null id are clustered and come last in the order of starts; ties and
repeated rows go to the smaller centroid number; an empty table gives an empty
result; columns other than id and vector aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace

CENTROIDS, ROUNDS, GROUPS, DIM, SCALE, SEED = 16, 3, 4, 64, 64, 1
_MOST, _FAR = 1 << 27, np.iinfo(np.int64).max
#: Floats hold the squares and sums of smaller integers exactly.
_EXACT = 1 << 21
_SLACK = 1e-9


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(``vec_id``, ``x``): the vectors that can be clustered, as arrays of integers."""
    v = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(_MOST)), F.least(F.lit(float(_MOST)), x.cast("double") * scale))).cast("int"))
    return vectors.where(v.isNotNull()).where(fine).select(F.col(vec_id).alias("vec_id"), floor.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``c`` (int64)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(1, x.shape[1]) ** 0.5 <= _EXACT:
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] - 2 * (fx @ fc.T) + (fc * fc).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def _up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + _SLACK) + _SLACK


def _down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - _SLACK) - _SLACK


def grouped(c: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each centroid, by a few Lloyd's rounds over the centroids themselves."""
    groups = min(groups, len(c))
    means = c[:groups].astype(np.float64)
    of = np.zeros(len(c), dtype=np.int64)
    for _ in range(5):
        of = ((c[:, None, :] - means) ** 2).sum(2).argmin(1)
        means = np.stack([c[of == g].mean(0) if (of == g).any() else means[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


class Step:
    """What one round does to a batch of vectors: centroids, their groups, and how far each moved."""

    def __init__(self, c: np.ndarray, of: np.ndarray, moved: np.ndarray | None = None):
        self.c, self.of, self.groups, self.moved = c, of, int(of.max()) + 1, moved
        self.scanned = 0  # exact distances taken, for tests

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment and bounds from scratch."""
        d = squared(x, self.c)
        self.scanned += d.size
        own = d.argmin(1)
        return own, _up(d[np.arange(len(x)), own]), self._lower(d, own, np.full((len(x), self.groups), np.inf))

    def _lower(self, d: np.ndarray, own: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each group the least distance in ``d`` but for the own centroid's, or ``most`` if that is less."""
        rest = d.copy()
        rest[np.arange(len(d)), own] = _FAR
        low = np.stack([_down(rest[:, self.of == g].min(1)) for g in range(self.groups)], axis=1)
        return np.minimum(low, most)

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the last round's assignment and bounds."""
        upper = (upper + self.moved[own]) * (1 + _SLACK)
        fell = np.array([self.moved[self.of == g].max() for g in range(self.groups)])
        lower = lower - fell - _SLACK * (np.abs(lower) + fell)
        own = own.copy()
        todo = np.flatnonzero(lower.min(1, initial=np.inf) <= upper)
        at = self.c[own[todo]]
        near = ((x[todo] - at) ** 2).sum(1)
        self.scanned += len(todo)
        upper[todo] = _up(near)
        still = lower[todo].min(1, initial=np.inf) <= upper[todo]
        todo, near = todo[still], near[still]
        if not len(todo):
            return own, upper, lower
        d = np.full((len(todo), len(self.c)), _FAR)
        asked = lower[todo] <= upper[todo][:, None]
        for g in range(self.groups):
            rows, members = np.flatnonzero(asked[:, g]), np.flatnonzero(self.of == g)
            if len(rows):
                d[np.ix_(rows, members)] = squared(x[todo[rows]], self.c[members])
                self.scanned += len(rows) * len(members)
        d[np.arange(len(todo)), own[todo]] = near
        new = d.argmin(1)
        lower[todo] = self._lower(d, new, np.where(asked, np.inf, lower[todo]))
        own[todo], upper[todo] = new, _up(d[np.arange(len(todo)), new])
        return own, upper, lower


def _assigned(rows: DataFrame, step: Step, dim: int, last: bool) -> DataFrame:
    """The rows with ``cluster`` and bounds, or with the exact distance after the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim).astype(np.int64)
            if step.moved is None:
                own, upper, lower = step.first(x)
            else:
                was = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, step.groups)
                own, upper, lower = step.again(x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), was)
            out = [b.column(0), b.column(1), pa.array(own.astype(np.int32))]
            if last:
                yield pa.RecordBatch.from_arrays([out[0], out[2], pa.array(((x - step.c[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])
            else:
                ends = pa.array(np.arange(0, (n + 1) * step.groups, step.groups, dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([*out, pa.array(upper), lists], ["vec_id", "x", "cluster", "upper", "lower"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint" if last else f"vec_id {kind}, x array<int>, cluster int, upper double, lower array<double>")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, groups: int = GROUPS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``) for each vector that can be clustered.

    Sums over clusters that don't fit 63 bits are given as the largest number that does.
    """
    spark = vectors.sparkSession
    space = Workspace(spark)
    rows = space.save(integers(vectors, dim=dim, scale=scale), "vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    c = np.array([r[0] for r in rows.orderBy(start.asc_nulls_last(), "x").limit(k).select("x").collect()], dtype=np.int64).reshape(-1, dim)
    if not len(c):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    of = grouped(c, groups)
    moved = None
    for r in range(rounds):
        rows = space.save(_assigned(rows, Step(c, of, moved), dim, False), f"round{r}")
        space.drop("vectors" if r == 0 else f"round{r - 1}")
        was = c.copy()
        sums = rows.groupBy("cluster").agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(j)).cast("bigint")) for j in range(dim)])
        for own, n, *total in sums.collect():  # one row for each centroid
            c[own] = [s // n for s in total]
        moved = _up(((c - was) ** 2).sum(1)) * (c != was).any(1)
    found = space.save(_assigned(rows, Step(c, of, moved), dim, True), "found")
    if rounds:
        space.drop(f"round{rounds - 1}")
    each = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total, most = sum(each.values()), int(_FAR)
    about = [(own, min(d, most), min(total, most), hashlib.sha256(",".join(map(str, c[own].tolist())).encode()).hexdigest()) for own, d in each.items()]
    about_them = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about_them), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
