"""Shared plumbing of the corpus operators: code shipping, written stages, bounded Arrow slices."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that one Arrow slice may hold before it is handed on.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, as an archive in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_kinosift_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    path = new_path(spark, "code") + "/kinosift_code.zip"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    context.addPyFile(path)
    context._kinosift_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local sessions without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not getattr(context, "_kinosift_shared", None):
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context._kinosift_shared = "file://" + tempfile.mkdtemp(prefix="kinosift-shared-")
    return context._kinosift_shared


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/kinosift/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    The shuffles behind it are no longer needed, so Spark is asked to delete them when the write ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._kinosift_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._kinosift_path)


def id_and_text(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id as long and text with null as empty, and the column row on request; every other column is left behind."""
    more = [] if row is None else [F.col(row).cast("long").alias("row")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each holds at most limit bytes, or one row."""
    for batch in batches:
        total = batch.num_rows
        if not total:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
