"""Incremental indexing: whatever files have come since the last run, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinosift.operators.joins import unfinished


def index_new(spark: SparkSession, source: str, schema: str, target: str, progress: str, encode: Callable[[DataFrame], DataFrame], key: str = "video_id", max_files: int = 200) -> None:
    """Encode the files below source that aren't in target yet and append them; a run that failed goes on where it was.

    Batches of max_files are the checkpoints.  A batch that is repeated after a failure finds its finished keys in the
    target and leaves them out.
    """

    def batch(rows: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(target)
            rows = unfinished(rows, done.select(key).distinct(), key)
        except Exception as missing:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        encode(rows).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", progress).foreachBatch(batch).start().awaitTermination()
