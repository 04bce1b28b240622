"""Writers: index shards, submissions, reports, failures."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinosift.operators.joins import complete_videos
from kinosift.sources.files import next_run

#: Fields of a detailed result, where predictions have them.
DETAILS = ("start_ms", "end_ms", "sim", "best_ms", "best_score")


def write_index(frames: DataFrame, path: str, expected: DataFrame | None = None) -> None:
    """Frame vectors, one folder per model, committed as a whole; with expected (video_id, n_frames), of complete videos only."""
    whole = frames if expected is None else complete_videos(frames, expected)
    whole.write.mode("append").partitionBy("model").parquet(path)


def write_metadata(rows: DataFrame, expected: DataFrame, path: str) -> None:
    """Frame metadata as JSON lines, one folder per video, of the videos whose frames are all there."""
    complete_videos(rows, expected).repartition("video_id").sortWithinPartitions("video_id", "ts_ms").write.mode("append").partitionBy("video_id").json(path)


def submission_json(predictions: DataFrame, detailed: bool = False) -> DataFrame:
    """One row per task: its results as JSON, by rank."""
    fields = ["rank", "video_id", "frame_ms"] + [c for c in DETAILS if c in predictions.columns] * detailed
    rows = predictions.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    return rows.select("task_id", F.to_json(F.struct("task_id", "results")).alias("value"))


def write_submission(predictions: DataFrame, path: str, detailed: bool = False) -> None:
    """A submission as text parts of one JSON object per task."""
    submission_json(predictions, detailed).select("value").write.mode("errorifexists").text(path)


def _small_file(spark: SparkSession, path: str, content: bytes) -> None:
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop, False)
    stream.write(bytearray(content))
    stream.close()


def save_run(predictions: DataFrame, root: str, config: dict) -> str:
    """A numbered folder below root with the submission, plain, detailed and zipped, and the settings; returns its path.

    A submission is a report of tasks times places, so it comes to the driver, task by task.
    """
    spark = predictions.sparkSession
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    run = f"{root.rstrip('/')}/{next_run([f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory()])}"
    plain, detailed = ('{"predictions":[' + ",".join(r["value"] for r in submission_json(predictions, d).orderBy("task_id").toLocalIterator()) + "]}" for d in (False, True))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("submission.json", plain)
    for name, content in (("submission.json", plain.encode()), ("detailed_submission.json", detailed.encode()), ("config.json", json.dumps(config, indent=2).encode()), ("submission.zip", packed.getvalue())):
        _small_file(spark, f"{run}/{name}", content)
    return run


def segment_report(queries: DataFrame) -> DataFrame:
    """Scene and objects of each sentence: first segment first."""
    rows = queries.groupBy("task_idx", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("all"))
    return rows.select("task_idx", "sent_idx", F.get("all", F.lit(0))["text"].alias("scene"), F.transform(F.slice("all", F.lit(2), F.size("all")), lambda s: s["text"]).alias("objects"))


def write_failures(rows: DataFrame, path: str, error: str = "error") -> None:
    """Tab-separated video_id and error of the rows that failed."""
    rows.filter(F.col(error).isNotNull()).select("video_id", error).write.mode("append").option("sep", "\t").csv(path)


def quarantine(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return rows.filter(F.col(error).isNull()), rows.filter(F.col(error).isNotNull())


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, header=True)
