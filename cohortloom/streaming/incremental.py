"""Resumable batch work as a stream of files: what was done before is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Applies ``transform`` to the parquet files that came since the last call, and appends the result.

    The checkpoint remembers files, so that a call after a failure goes on where it stopped.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def process_to_outputs(spark: SparkSession, source: str, schema: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], target: str, checkpoint: str) -> None:
    """Writes several results of the files that came since the last call, each once, whatever fails in between.

    The stream's log fixes which files a batch has before any of its outputs is written. Each output
    of a batch is a folder of its own, ``<name>/batch=<number>``, which a repetition overwrites: a batch
    that died between two writes is repaired, not doubled. Outputs are read with ``output``.
    Rows that an output should not have (rejects) are an output like any other.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            for name, of in outputs.items():
                of(rows).write.mode("overwrite").parquet(f"{target}/{name}/batch={batch}")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def output(spark: SparkSession, target: str, name: str) -> DataFrame:
    """All batches of one output, with their number as ``batch``."""
    return spark.read.parquet(f"{target}/{name}")


def undone(ids: DataFrame, id: str, done: DataFrame) -> DataFrame:
    """Ids without a result yet."""
    return ids.join(done.select(id), id, "left_anti")
