"""Moment retrieval from frame vectors and sub-query vectors to ranked predictions, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.config import RetrievalConfig
from kinosift.functions.vectors import smoothed
from kinosift.operators import scoring, sequence, suppression


def task_scores(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """task_idx, video_id, ts_ms, s: one array of scene scores per task and frame."""
    rows = scenes.groupBy("task_idx", "frame_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "score"))).alias("all"))
    rows = rows.select("task_idx", "frame_id", F.transform("all", lambda x: x["score"]).alias("s"))
    return rows.join(frames.select("frame_id", "video_id", "ts_ms"), "frame_id").select("task_idx", "video_id", "ts_ms", "s")


def _in_sequence(fused: DataFrame, frames: DataFrame, config: RetrievalConfig, scenes: int, tasks: DataFrame | None) -> DataFrame:
    """Candidates of tasks with several scenes, at most as many as scenes."""
    scored = task_scores(fused, frames)
    found = sequence.chains(scored, scenes, config.max_gap_ms, config.discount, config.chain_mode, config.clip_to_zero)
    spans = found.withColumns({"start_ms": F.element_at("path", 1), "end_ms": F.element_at("path", -1)})
    kept = suppression.per_video(spans, config.max_per_video)
    # Only the best moment needs the scores once more.
    best = sequence.with_best_moment(kept.drop("start_ms", "end_ms"), scored) if config.position == "best" else kept
    target = None
    if tasks is not None:
        best = best.join(F.broadcast(tasks.select("task_idx", F.col("target_scene").cast("int").alias("target_scene"))), "task_idx", "left")
        target = F.col("target_scene")
    moments = best.withColumns({"moment_ms": sequence.chosen_moment(config.position, target), "edge": sequence.chosen_edge(config.position, target)})
    moments = sequence.snapped(moments.select("task_idx", "video_id", "ts_ms", "score", "start_ms", "end_ms", "moment_ms", "edge"), frames)
    moments = moments.withColumn("key", F.concat_ws("-", "task_idx", "video_id", "ts_ms"))
    moved = sequence.slid(moments.drop("ts_ms"), frames, config.slide_threshold)
    return moved.select("task_idx", "video_id", F.col("slid_ms").alias("frame_ms"), F.col("score").alias("sim"), "start_ms", "end_ms")


def _by_mean(fused: DataFrame, frames: DataFrame) -> DataFrame:
    """Candidates by the mean over the scenes: the best frame of each video."""
    best = scoring.best_frame_per_video(fused, frames)
    return best.select("task_idx", "video_id", "frame_ms", "sim", F.col("frame_ms").alias("start_ms"), F.col("frame_ms").alias("end_ms"))


def retrieve(frames: DataFrame, queries: DataFrame, config: RetrievalConfig, sequential: bool = True, tasks: DataFrame | None = None) -> DataFrame:
    """task_idx, rank, video_id, frame_ms, start_ms, end_ms, sim.

    frames: frame_id, video_id, frame_no, ts_ms, emb; queries: query_id, task_idx, sent_idx, seg_idx, vec; tasks, if given: task_idx,
    target_scene and max_predictions, null where a task has none.  A task has as many scenes as its queries; those of one
    scene go by the mean.
    """
    seen = smoothed(frames, config.smoothing_window, config.smoothing_sigma)
    if sequential:
        sims = scoring.similarity_blocks(queries, seen)
        held = sims.join(F.broadcast(queries.select("query_id", "task_idx", "sent_idx", "seg_idx")), "query_id")
        fused = scoring.scene_scores(held, config.fusion_mode, config.main_weight)
        counts = queries.groupBy("task_idx").agg(F.countDistinct("sent_idx").alias("n"))
        least, most = counts.agg(F.min("n"), F.max("n")).first()
        if most is None or most == 1:
            candidates = _by_mean(fused, frames)
        elif least > 1:
            candidates = _in_sequence(fused, frames, config, most, tasks)
        else:
            single = F.broadcast(counts.filter("n = 1").select("task_idx"))
            chained = _in_sequence(fused.join(single, "task_idx", "left_anti"), frames, config, most, tasks)
            candidates = chained.unionByName(_by_mean(fused.join(single, "task_idx", "left_semi"), frames))
    else:
        top = scoring.top_similar(queries, seen, config.candidate_frames)
        candidates = _by_mean(scoring.scene_scores(scoring.densified(top, queries, frames), config.fusion_mode, config.main_weight), frames)
    if tasks is None:
        predictions, most = suppression.formatted(candidates, config.top_videos), config.top_videos
    else:
        most = tasks.agg(F.max("max_predictions")).first()[0]
        most = max(most or 0, config.top_videos)
        limits = F.broadcast(tasks.select("task_idx", F.col("max_predictions").alias("_limit")))
        predictions = suppression.formatted(candidates, None).join(limits, "task_idx", "left").filter(F.col("rank") <= F.coalesce("_limit", F.lit(config.top_videos))).drop("_limit")
    return suppression.exclusion(predictions, config.overlap_ms, most=most)
