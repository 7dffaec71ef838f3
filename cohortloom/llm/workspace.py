"""Intermediate tables in the folder that the cluster shares.

An operator that reads an intermediate result more than once, or that must cut
a long lineage, writes it as Parquet below ``spark.checkpoint.dir``: unlike a
local checkpoint, such a table survives the loss of any executor. The setting
is read from the session; only where it is unset (tests on one machine) is a
temporary folder made.

An operator drops a table once nothing reads it any more; what its result still
reads stays until the caller has written or collected the result: calls made
within ``closing`` lose their tables at its end, and ``release`` deletes all.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: What was shuffled for a table isn't read again once the table is written, and small tables are one file.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
}
_LOCK = threading.RLock()
_WRITING: dict[str, object] = {"n": 0, "was": {}}
_SPACES: list[Workspace] = []
_OPENED: ContextVar[list[Workspace] | None] = ContextVar("opened", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, seen by the driver and by every executor."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cohortloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables of one run; each is written once, then read as often as needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cohortloom-{uuid.uuid4().hex}"
        _SPACES.append(self)
        opened = _OPENED.get()
        if opened is not None:
            opened.append(self)

    def save(self, df: DataFrame, name: str, by: list[str] | None = None, heavy: bool = False, grouped: bool = False) -> DataFrame:
        """Write ``df``, in a folder for each value of ``by``, and return it as read back: its lineage ends here.

        ``heavy``: rows cost much more work than their size suggests, so all cores shall share them.
        ``grouped``: groups are worked on one by one, so partitions stay as the session deals them.
        """
        return self._written(df, name, by, heavy, grouped)

    def save_counted(self, df: DataFrame, name: str, *sums: Column, heavy: bool = False) -> tuple[DataFrame, tuple]:
        """The same, with aggregates over the rows that are taken while they are written."""
        seen = Observation()
        named = [c.alias(f"s{k}") for k, c in enumerate(sums)]
        out = self._written(df.observe(seen, F.count(F.lit(1)).alias("n"), *named), name, heavy=heavy)
        return out, tuple(seen.get[k] for k in ("n", *(f"s{k}" for k in range(len(sums)))))

    def _written(self, df: DataFrame, name: str, by: list[str] | None = None, heavy: bool = False, grouped: bool = False) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        # The settings are the session's: the last of several threads that write puts them back.
        with _LOCK:
            if not _WRITING["n"]:
                _WRITING["was"] = {k: conf.get(k) for k in _SETTINGS}
            _WRITING["n"] += 1
            for k, v in _SETTINGS.items():
                conf.set(k, _WRITING["was"][k] if grouped and "adaptive" in k else "true" if heavy and v == "false" else v)
        try:
            df.write.mode("overwrite").partitionBy(*by or ()).parquet(path)
        finally:
            with _LOCK:
                _WRITING["n"] -= 1
                if not _WRITING["n"]:
                    for k, v in _WRITING["was"].items():
                        conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Delete all tables of this run."""
        self._delete(self.root)
        if self in _SPACES:
            _SPACES.remove(self)


@contextmanager
def closing() -> Iterator[None]:
    """Deletes, at its end, the tables of the operators called within it, and no others: for a caller that has written their results by then."""
    opened: list[Workspace] = []
    token = _OPENED.set(opened)
    try:
        yield
    finally:
        _OPENED.reset(token)
        for space in opened:
            space.close()


def release(*but: Workspace) -> None:
    """Delete the tables of all operators called so far, except these; their results can't be read after that."""
    for space in [s for s in _SPACES if s not in but]:
        space.close()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def input_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total size of a text column in bytes (one cheap scan)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])
