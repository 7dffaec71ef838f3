"""Writers: delimited text, partitioned parquet, batches, safe replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def delimited(df: DataFrame, path: str, sep: str = ",", single: bool = False, only_if_rows: bool = False) -> bool:
    """Writes text with a header; ``single`` gathers one file, for small results. False if nothing was written."""
    if only_if_rows and df.isEmpty():
        return False
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return True


def replaced(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Overwrites a delimited folder that ``df`` may itself be reading: written beside it, then moved into its place."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    df.write.option("header", True).option("sep", sep).csv(new)
    target, fresh, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.rename(target, kept)
    if not fs.rename(fresh, target):
        fs.rename(kept, target)
        raise OSError(f"can't move the new rows to {path}")
    fs.delete(kept, True)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of pointers, oldest first: a running number, then the version that it points at."""
    at, fs, _ = _fs(spark, f"{path.rstrip('/')}/pointers")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if not n.startswith("."))


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the newest pointer names, if there is one."""
    names = _pointers(spark, path)
    return names[-1].partition("-")[2] if names else None


def published(df: DataFrame, path: str) -> str:
    """Replaces a table that ``df`` may itself be reading, so that readers see the old rows or the new ones, never neither.

    Rows go to a folder of their own, which nobody reads before a pointer names it. A pointer is an
    empty file that says all by its name and is never replaced, so that it is there at once or not at
    all on any file system. A crash before that leaves the old version current, and at most a folder
    that ``swept`` takes away. Returns the version's name.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    version = uuid.uuid4().hex
    df.write.parquet(f"{base}/versions/{version}")
    point(spark, base, version)
    return version


def point(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version that is there the current one; of two at the same time the greater name counts."""
    names = _pointers(spark, path)
    number = int(names[-1].partition("-")[0]) + 1 if names else 0
    at, fs, _ = _fs(spark, f"{path.rstrip('/')}/pointers/{number:020d}-{version}")
    fs.create(at, False).close()


def swept(spark: SparkSession, path: str, older: float = 0.0) -> int:
    """Deletes versions that aren't current and haven't changed for ``older`` seconds, and their pointers; returns how many.

    Give readers that hold an old version, and writers that haven't published yet, that much time.
    """
    import time

    at, fs, _ = _fs(spark, f"{path.rstrip('/')}/versions")
    names, n = _pointers(spark, path), 0
    kept = names[-1].partition("-")[2] if names else None
    for s in fs.listStatus(at) if fs.exists(at) else []:
        version = s.getPath().getName()
        if version != kept and s.getModificationTime() <= (time.time() - older) * 1000:
            for name in names:
                if name.endswith(f"-{version}"):
                    fs.delete(_fs(spark, f"{path.rstrip('/')}/pointers/{name}")[0], False)
            fs.delete(s.getPath(), True)
            n += 1
    return n


def by_input(df: DataFrame, path: str, file: str) -> None:
    """One output for each input file, in a folder named after it; large ones have several files."""
    partitioned(df, path, [file])


def partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """One dataset with a folder for each value; rows of a value are gathered before they are written.

    Rows are rebalanced: adaptive execution splits what one value has beyond the advisory size of a
    partition and joins small ones, so a value has as many files as its bytes ask for.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).option("compression", "snappy").parquet(path)


def split_dataset(embeddings: DataFrame, sheet: DataFrame, id: str, path: str, split: str = "train_val_eval") -> None:
    """Labelled embeddings in a folder for each split."""
    partitioned(embeddings.join(sheet, id), path, [split])


def wide_matrix(df: DataFrame, key: str, embedding: str, dims: int, path: str) -> None:
    from cohortloom.operators.vectors import wide

    wide(df, key, embedding, dims).write.mode("overwrite").option("compression", "snappy").parquet(path)


def batches(df: DataFrame, order: str, size: int, path: str) -> None:
    """Text files in a folder for each batch."""
    from cohortloom.operators.batching import fixed

    fixed(df.select(order), order, size).select(F.col(order).cast("string").alias("value"), "batch_name").write.mode("overwrite").partitionBy("batch_name").text(path)


def rejects(df: DataFrame, path: str) -> int:
    """Writes the rows that failed, and returns how many there are."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).csv(path).count() if df.columns else 0


def per_group(df: DataFrame, path: str, column: str, reference: DataFrame | None = None, skip: tuple[str, ...] = ()) -> None:
    """A delimited folder for each value of ``column`` but the skipped ones, each with the reference rows at its end."""
    from cohortloom.operators.reconcile import with_reference

    rows = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*skip)) if skip else df.where(F.col(column).isNotNull())
    if reference is not None:
        # One name for each folder that is written.
        groups = [r[0] for r in rows.select(column).distinct().orderBy(column).collect()]
        rows = with_reference(rows, reference, groups, column) if groups else rows
    rows.write.mode("overwrite").partitionBy(column).option("header", True).option("sep", "\t").csv(path)


def annotated(rows: DataFrame, samples: DataFrame, params: dict[str, object], path: str) -> None:
    """Rows with their vectors, the table of their samples, and the run's parameters as text, side by side as parquet."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    pairs = [(str(k), str(v)) for k, v in sorted(params.items())]
    rows.sparkSession.createDataFrame(pairs, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
