"""The whole way from frames and tasks to ranked moments, and what is looked at afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.config import RetrievalConfig
from kinosift.functions.text import expanded_queries
from kinosift.operators import encoders, evaluation, scoring
from kinosift.plans.index import IndexModels, indexed
from kinosift.plans.retrieve import retrieve


def asked(tasks: DataFrame, model: str = "hashed", scene: str = "regex", objects: str = "none") -> DataFrame:
    """query_id, task_idx, sent_idx, seg_idx, vec of tasks (task_idx, description): cut, expanded and encoded."""
    rows = expanded_queries(tasks, scene=scene, objects=objects)
    number = (F.col("task_idx").cast("long") * 1_000_000 + F.col("sent_idx") * 1_000 + F.col("seg_idx")).alias("query_id")
    vector = encoders.model("text", model)("text").cast("array<double>").alias("vec")
    return rows.select(number, F.col("task_idx").cast("long").alias("task_idx"), "sent_idx", "seg_idx", vector)


def answered(images: DataFrame, tasks: DataFrame, config: RetrievalConfig, models: IndexModels = IndexModels(), text_model: str = "hashed") -> tuple[DataFrame, DataFrame]:
    """Predictions with their task_id, and the frames that failed.

    images: frame_id, video_id (long), frame_no, ts_ms, image; tasks: task_id, task_idx, description and, if it is there, max_predictions.
    """
    index, failed = indexed(images.select(F.col("video_id"), "frame_no", "ts_ms", "image"), models)
    places = images.select("frame_id", "video_id", "frame_no")
    frames = index.join(places, ["video_id", "frame_no"]).select("frame_id", "video_id", "frame_no", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("emb").cast("array<double>").alias("emb"))
    limits = tasks.select(F.col("task_idx").cast("long").alias("task_idx"), F.lit(None).cast("int").alias("target_scene"), "max_predictions") if "max_predictions" in tasks.columns else None
    found = retrieve(frames, asked(tasks, text_model), config, tasks=limits)
    return found.join(F.broadcast(tasks.select("task_id", F.col("task_idx").cast("long").alias("task_idx"))), "task_idx"), failed


def analysis(sims: DataFrame, texts: DataFrame, labels: DataFrame, bins: int = 50) -> dict[str, DataFrame]:
    """Reports on an index: the spread and the histogram of similarities, the share of frames with a text, and the smoothed categories.

    sims: sim; texts: text; labels: video_id, frame_no, category.
    """
    return {
        "spread": evaluation.spread(sims, "sim"),
        "histogram": evaluation.histogram(sims, "sim", bins),
        "coverage": evaluation.coverage(texts),
        "categories": scoring.voted(labels).groupBy("voted").agg(F.count(F.lit(1)).alias("frames")),
    }
