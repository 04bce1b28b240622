"""Greedy interval suppression, ranking and the exclusion across tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _greedy(ordered, limit: int | None, pad: int = 0):
    """Fold over an ordered array of structs with start_ms and end_ms: keep what overlaps nothing kept; ends count."""

    def step(kept, x):
        clash = F.exists(kept, lambda k: (F.greatest(k["start_ms"], x["start_ms"]) - pad) <= (F.least(k["end_ms"], x["end_ms"]) + pad))
        full = F.size(kept) >= limit if limit is not None else F.lit(False)
        return F.when(full | clash, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def per_video(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """Per task and video the best intervals that don't overlap; equal scores go by the later end frame.  A path is carried along."""
    fields = ["score", "ts_ms", "start_ms", "end_ms", *(["path"] if "path" in candidates.columns else [])]
    rows = F.struct((-F.col("score")).alias("minus"), (-F.col("ts_ms")).alias("late"), *fields)
    groups = candidates.groupBy("task_idx", "video_id").agg(F.array_sort(F.collect_list(rows)).alias("all"))
    kept = groups.select("task_idx", "video_id", F.posexplode(_greedy(F.col("all"), limit)).alias("emit_no", "k"))
    return kept.select("task_idx", "video_id", "emit_no", *[F.col(f"k.{n}").alias(n) for n in fields])


def ranked(candidates: DataFrame, limit: int | None = 10) -> DataFrame:
    """The best candidates of each task with dense ranks from 1; order: sim, video_id, frame_ms."""
    order = Window.partitionBy("task_idx").orderBy(F.desc("sim"), "video_id", "frame_ms")
    rows = candidates.withColumn("rank", F.row_number().over(order))
    return rows if limit is None else rows.filter(F.col("rank") <= limit)


def formatted(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """Suppression per task and video over any candidates, then the best ones of each task."""
    rows = F.struct((-F.col("sim")).alias("minus"), "frame_ms", "sim", "start_ms", "end_ms")
    groups = candidates.groupBy("task_idx", "video_id").agg(F.array_sort(F.collect_list(rows)).alias("all"))
    kept = groups.select("task_idx", "video_id", F.explode(_greedy(F.col("all"), None)).alias("k"))
    flat = kept.select("task_idx", "video_id", *[F.col(f"k.{n}").alias(n) for n in ("frame_ms", "sim", "start_ms", "end_ms")])
    return ranked(flat, limit)


#: Predictions that one fold over all tasks may hold.
FOLD_ROWS = 1_000_000


def exclusion(predictions: DataFrame, pad_ms: int, cap: int = 10, most: int | None = None) -> DataFrame:
    """One interval per moment across all tasks, best first, padded on both compared sides; at most cap per task.

    most: the number of predictions that no task exceeds, if known.  With at most cap of them the cap can't bind, and the greedy
    choice falls apart into one fold per video.  Otherwise tasks compete for places and one fold over all predictions decides: a report
    of tasks times places, not the corpus; an error if it has more than FOLD_ROWS rows.
    """
    fields = ("task_idx", "rank", "frame_ms", "sim", "start_ms", "end_ms")
    if most is not None and most <= cap:
        rows = F.struct((-F.col("sim")).alias("minus"), *fields)
        groups = predictions.groupBy("video_id").agg(F.array_sort(F.collect_list(rows)).alias("all"))
        kept = groups.select("video_id", F.explode(_greedy(F.col("all"), None, pad_ms)).alias("k")).select("video_id", *[F.col(f"k.{n}").alias(n) for n in fields])
    else:
        if predictions.limit(FOLD_ROWS + 1).count() > FOLD_ROWS:
            raise ValueError(f"more than {FOLD_ROWS} predictions compete for places")
        kept = _capped(predictions, pad_ms, cap)
    order = Window.partitionBy("task_idx").orderBy(F.desc("sim"), "rank")
    return kept.withColumn("new_rank", F.row_number().over(order)).select("task_idx", "video_id", "frame_ms", "sim", "start_ms", "end_ms", F.col("new_rank").alias("rank"))


def _capped(predictions: DataFrame, pad_ms: int, cap: int) -> DataFrame:
    fields = ("task_idx", "rank", "video_id", "frame_ms", "sim", "start_ms", "end_ms")
    rows = F.struct((-F.col("sim")).alias("minus"), *fields)

    def step(kept, x):
        near = lambda k: (k["video_id"] == x["video_id"]) & ((F.greatest(k["start_ms"], x["start_ms"]) - pad_ms) <= (F.least(k["end_ms"], x["end_ms"]) + pad_ms))
        full = F.size(F.filter(kept, lambda k: k["task_idx"] == x["task_idx"])) >= cap
        return F.when(full | F.exists(kept, near), kept).otherwise(F.concat(kept, F.array(x)))

    whole = predictions.agg(F.array_sort(F.collect_list(rows)).alias("all"))
    return whole.select(F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("k")).select(*[F.col(f"k.{n}").alias(n) for n in fields])
