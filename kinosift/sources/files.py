"""Readers of the pipeline's files; schemas are stated, malformed rows are dropped where the format allows."""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = "task_id string, description string, submission_type string, max_predictions int"
LABELS = "task_id string, description string, answer_video_id string, answer_start_ms int, answer_end_ms int, confidence double, description_quartile int"
METADATA = "video_id string, ts_ms int, shard_index int, ocr string, objects array<string>, caption string"
SUBMISSION = "predictions array<struct<task_id:string,results:array<struct<rank:int,video_id:string,frame_ms:long>>>>"
TRANSCRIPTS = "map<string,array<struct<start:double,end:double,text:string>>>"
INDEX = "video_id string, frame_no int, ts_ms int, emb array<float>"
# Fixed value: the mark of a frame's time in a decoder's log.
TIME_MARK = r"pts_time:([0-9.]+)"


def video_id(path: Column) -> Column:
    """Collection, in lower case, and stem of a path like .../COLLECTION/videos/x/STEM.mp4."""
    return F.concat_ws("_", F.lower(F.regexp_extract(path, r"([^/]+)/videos/", 1)), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1))


def collection(path: Column) -> Column:
    """Collection named somewhere in a path."""
    return F.when(F.upper(path).contains("V3C1"), "v3c1").when(F.upper(path).contains("V3C2"), "v3c2").otherwise("v3c")


def videos(spark: SparkSession, root: str) -> DataFrame:
    """video_id and path of all videos below a root, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true").load(root).select("path")
    return found.select(video_id(F.col("path")).alias("video_id"), "path")


def video_list(spark: SparkSession, path: str) -> DataFrame:
    """The same from a file of one path per line; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")
    return lines.select(F.concat_ws("_", collection(F.col("path")), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("video_id"), "path")


def tasks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Tasks with task_idx, their place in the file; the limit counts in that order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).filter(F.trim("value") != "")
    parsed = lines.select("line", F.from_json("value", TASKS).alias("t")).select("line", "t.*")
    at = parsed.select("line").orderBy("line")
    numbered = at.agg(F.array_sort(F.collect_list("line")).alias("all")).select(F.posexplode("all").alias("task_idx", "line"))
    rows = parsed.join(F.broadcast(numbered), "line").drop("line").withColumn("max_predictions", F.coalesce("max_predictions", F.lit(10)))
    return rows if limit is None else rows.filter(F.col("task_idx") < limit)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=LABELS, header=True, quote='"', escape='"', multiLine=True)


def submission(spark: SparkSession, path: str) -> DataFrame:
    """task_id, rank, video_id, frame_ms; of a task that comes twice the last counts."""
    rows = spark.read.json(path, schema=SUBMISSION, multiLine=True).select(F.posexplode("predictions").alias("at", "p"))
    last = rows.groupBy("p.task_id").agg(F.max_by("p.results", "at").alias("results"))
    return last.select("task_id", F.explode("results").alias("r")).select("task_id", "r.*")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Frame metadata lines; those that aren't JSON are skipped."""
    lines = spark.read.text(path).select(F.from_json("value", METADATA, {"mode": "PERMISSIVE"}).alias("m"))
    return lines.select("m.*").filter("ts_ms is not null")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """video_stem, seg_no, start, end, text; of files that tell of one video the last by name counts."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", TRANSCRIPTS).alias("m"))
    rows = files.filter("m is not null").select("file", F.explode("m").alias("video_stem", "segments"))
    last = rows.groupBy("video_stem").agg(F.max_by("segments", "file").alias("segments"))
    return last.select("video_stem", F.posexplode("segments").alias("seg_no", "s")).select("video_stem", "seg_no", "s.*")


def frame_times(log: Column) -> Column:
    """Milliseconds, half to even, of all pts_time marks in a decoder's log."""
    return F.transform(F.regexp_extract_all(log, F.lit(TIME_MARK), F.lit(1)), lambda x: F.bround(x.cast("decimal(20,6)") * 1000, 0).cast("int"))


def paired_frames(images: Column, times: Column) -> Column:
    """Sorted images with their times; what is longer is cut."""
    n = F.least(F.size(images), F.size(times))
    return F.arrays_zip(F.slice(F.array_sort(images), 1, n).alias("image"), F.slice(times, 1, n).alias("ts_ms"))


def timed_frames(images: Column, log: Column) -> Column:
    """Sorted images with the times of a decoder's log; a log without times counts one second a frame."""
    times = frame_times(log)
    seconds = F.transform(F.sequence(F.lit(0), F.size(images)), lambda i: (i * 1000).cast("int"))
    return paired_frames(images, F.when(F.size(times) > 0, times).otherwise(seconds))


def whole_image(content: Column) -> Column:
    """Whether bytes begin and end as a JPEG or PNG file does; what doesn't is left out of an index."""
    head, tail = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, -8, 8))
    return F.coalesce((head.startswith("FFD8FF") & tail.endswith("FFD9")) | ((head == "89504E470D0A1A0A") & tail.startswith("49454E44")), F.lit(False))


def keyframe_folders(spark: SparkSession, root: str, marker: str = "ts_ms.npy") -> DataFrame:
    """video_id and path of the folders below a root that hold a marker file; the marker itself isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", marker).option("recursiveFileLookup", "true").load(root)
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return found.select(F.regexp_extract(folder, r"([^/]+)$", 1).alias("video_id"), folder.alias("path"))


def index_shards(spark: SparkSession, path: str) -> DataFrame:
    """video_id, frame_no, ts_ms, emb from a folder of array archives, one for each video and named by it, with arrays emb and ts_ms."""
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("video_id"), "content")

    def run(batches):
        for batch in batches:
            for video, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.load(io.BytesIO(content)) as arrays:
                    emb, times = arrays["emb"].astype(np.float32), arrays["ts_ms"].astype(np.int32)
                n = len(emb)
                if n:
                    vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * emb.shape[1], emb.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([video] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(times), vectors], names=["video_id", "frame_no", "ts_ms", "emb"])

    return shards.mapInArrow(run, INDEX)


def video_glob(path: str) -> str:
    """The pattern of all videos below a folder of collections or of one collection's videos; a pattern stays as it is."""
    if path.endswith("*.mp4"):
        return path
    return path.rstrip("/") + ("/*/*.mp4" if "videos" in path else "/*/videos/*/*.mp4")


def latest_run(names: list[str], modified: dict[str, float] | None = None) -> str | None:
    """The run folder of the highest number; without numbers the one that was modified last, if that is known."""
    numbered = max((n for n in names if re.fullmatch(r"\d+", n)), key=int, default=None)
    return numbered if numbered is not None or not modified else max((n for n in names if n in modified), key=modified.__getitem__, default=None)


def next_run(names: list[str]) -> str:
    """The name of the next numbered run folder."""
    return f"{int(latest_run(names) or 0) + 1:03d}"
