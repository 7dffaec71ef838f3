"""Embeddings: pooling, exploding, padding, neighbours."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import rank_within


def mean_pool(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """Mean vector of each key. Sums are combined by dimension before anything is shuffled."""
    dims = df.select(key, F.posexplode(embedding).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    pooled = dims.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_v"))  # as many as dimensions
    return pooled.select(key, F.transform("_v", lambda p: p["x"]).alias("embedding"))


def mean_of_rows(matrix: Column) -> Column:
    """Mean over the vectors inside one row (an array of arrays)."""
    total = F.aggregate(F.slice(matrix, 2, F.greatest(F.size(matrix) - 1, F.lit(0))), F.transform(F.get(matrix, F.lit(0)), lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(matrix))


def exploded(df: DataFrame, key: str, matrix: str) -> DataFrame:
    """One row for each vector of a nested array: (key, ``gene_idx``, ``embedding``)."""
    return df.select(key, F.posexplode(matrix).alias("gene_idx", "embedding"))


def gene_rows(df: DataFrame, sample: str, gene: str, embedding: str) -> DataFrame:
    """Numbers the vectors of each sample from 0 by ``gene``."""
    ranked = rank_within(df.select(sample, gene, embedding), [sample], [F.col(gene)], "_rank")
    return ranked.select(sample, gene, (F.col("_rank") - 1).alias("gene_idx"), embedding)


def padded(df: DataFrame, batch: str, column: str, fill: float = 0.0) -> DataFrame:
    """Arrays filled up to the longest of their batch, and the mask of what was there."""
    longest = df.groupBy(batch).agg(F.max(F.size(column)).alias("_n"))
    out = df.join(longest, batch)
    lack = F.col("_n") - F.size(column)
    kind = dict(df.dtypes)[column]
    return out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(column)), F.array_repeat(F.lit(0), lack))).withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(fill), lack).cast(kind))).drop("_n")


def by_file(df: DataFrame, wanted: DataFrame, file: str, key: str) -> DataFrame:
    """Rows whose (file, key) is wanted: one scan and one semi join in place of a loop over files."""
    return df.join(wanted.select(file, key), [file, key], "left_semi")


def first_of_columns(df: DataFrame, names: list[str], zeros: Column) -> Column:
    """The first non-null of the columns that there are, else zeros."""
    return F.coalesce(*[F.col(c) for c in names if c in df.columns], zeros)


def squeezed(matrix: Column) -> Column:
    """The only vector of a batch of one; an error if there are more, null if there is none."""
    return F.when(F.size(matrix) > 1, F.raise_error(F.lit("more than one vector")).cast("array<double>")).otherwise(F.get(matrix, F.lit(0)).cast("array<double>"))


def unsqueezed(vector: Column) -> Column:
    """A batch of one."""
    return F.array(vector)


def wide(df: DataFrame, key: str, embedding: str, dims: int) -> DataFrame:
    """One column for each dimension."""
    return df.select(key, *[F.get(embedding, F.lit(i)).alias(f"dim_{i}") for i in range(dims)])


#: Similarities that a task holds at once.
CELLS = 1 << 21


def nearest(queries: DataFrame, vectors: DataFrame, id: str, embedding: str, k: int, limit: int = 20_000) -> DataFrame:
    """The k vectors of largest cosine similarity for each of the queries (others than itself).

    The queries are handed out in blocks of at most ``limit``; each task holds its batch of
    vectors against a whole block, and keeps its own best k before the shuffle. For few queries,
    whose vectors needn't be among the others; ``neighbours.graph`` takes any number of rows of one table.

    A vector that is null or empty, or holds a null or a number that isn't finite, neither asks nor is
    found; so has one of another length than the first one, queries before others.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(vectors.dtypes)[id]
    schema, best = f"query {kind}, {id} {kind}, cosine double", None
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    fine = (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries, vectors = (d.where(F.col(id).isNotNull() & F.col(embedding).isNotNull()).where(fine) for d in (queries, vectors))
    length = queries.select(F.size(embedding)).first()
    if length is not None:
        queries, vectors = (d.where(F.size(embedding) == length[0]) for d in (queries, vectors))
    rows = queries.select(id, embedding).toLocalIterator()
    while block := list(islice(rows, limit)):
        ids = np.array([r[0] for r in block])
        q = unit(np.array([r[1] for r in block], dtype=np.float64))

        def run(batches, ids=ids, q=q):
            for b in batches:
                own, v = b.column(0).to_numpy(), unit(np.array(b.column(1).to_pylist(), dtype=np.float64))
                step = max(1, CELLS // max(1, len(own)))
                for at in range(0, len(q), step):
                    query = ids[at : at + step]
                    s = q[at : at + step] @ v.T
                    s[query[:, None] == own[None, :]] = -np.inf
                    n = min(k, s.shape[1])
                    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    # Where others tie with the last one, the smallest ids stay.
                    last = np.take_along_axis(s, best, axis=1).min(axis=1)
                    for r in np.flatnonzero((s >= last[:, None]).sum(axis=1) > n):
                        best[r] = np.lexsort((own, -s[r]))[:n]
                    value = np.take_along_axis(s, best, axis=1)
                    keep = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, n)[keep.ravel()]), pa.array(own[best][keep]), pa.array(value[keep])], ["query", id, "cosine"])

        part = vectors.select(id, embedding).mapInArrow(run, schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return queries.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), id)
    return best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
