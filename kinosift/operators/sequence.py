"""Ordered frame sequences: the best chain of one frame per scene, and what is read off it."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinosift.functions import vectors
from kinosift.operators.joins import with_nearest


def chains(scores: DataFrame, scenes: int, gap_ms: int, discount: float, mode: str = "add", clip: bool = False) -> DataFrame:
    """task_idx, video_id, ts_ms, score, path for each frame that can end a chain of all scenes.

    scores: task_idx, video_id, ts_ms (unique in a video), s (array of one score per scene); scenes is the most that a task has, and
    the chains of shorter tasks end with their own last scene.  A frame follows an earlier one
    of the same video at most gap_ms before; of equal predecessors the latest counts.  Every scene is one window over the
    same partitioning, so there is one shuffle and one sort.  In the product mode a frame without predecessor continues with 0
    from the video's first frame.
    """
    value = lambda m: F.least(F.greatest(F.get("s", F.lit(m)), F.lit(0.0)), F.lit(1.0)) if clip else F.get("s", F.lit(m))
    group = Window.partitionBy("task_idx", "video_id").orderBy("ts_ms")
    before = group.rangeBetween(-gap_ms, -1)
    held = scores.withColumn("ts_ms", F.col("ts_ms").cast("long"))
    held = held.withColumn("dp", value(0).cast("double")).withColumn("path", F.array("ts_ms"))
    if mode == "prod":
        held = held.withColumn("_first", F.min("ts_ms").over(Window.partitionBy("task_idx", "video_id")))
    for m in range(1, scenes):
        held = held.withColumn("_best", F.max(F.when(F.col("dp").isNotNull(), F.struct("dp", "ts_ms", "path"))).over(before))
        if mode == "prod":
            dp = F.coalesce(F.col("_best.dp"), F.lit(0.0)) * value(m)
            path = F.concat(F.coalesce(F.col("_best.path"), F.array_repeat("_first", m)), F.array("ts_ms"))
        else:
            dp = F.col("_best.dp") + value(m) * F.lit(discount**m)
            path = F.when(F.col("_best.dp").isNotNull(), F.concat("_best.path", F.array("ts_ms")))
        longer = F.size("s") > m
        held = held.withColumns({"dp": F.when(longer, dp).otherwise(F.col("dp")), "path": F.when(longer, path).otherwise(F.col("path"))})
    return held.filter(F.col("dp").isNotNull() & (F.col("dp") > -1e5)).select("task_idx", "video_id", "ts_ms", F.col("dp").alias("score"), "path")


def within(spans: DataFrame, frames: DataFrame, keys: list[str], bucket_ms: int = 60_000) -> DataFrame:
    """spans joined with the frames whose time ``at`` lies in start_ms..end_ms, ends included.

    Spans are filed under every bucket of time that they touch, so the range join is an equi-join on keys and bucket and a
    long video is dealt over many tasks.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_ms).cast("long")
    filed = spans.withColumn("_bucket", F.explode(F.sequence(bucket("start_ms"), bucket("end_ms"))))
    return filed.join(frames.withColumn("_bucket", bucket("at")), [*keys, "_bucket"]).filter(F.col("at").between(F.col("start_ms"), F.col("end_ms"))).drop("_bucket")


def with_best_moment(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Add start_ms, end_ms, best_ms and best_score: the frame inside with the highest mean over the scenes, the first on ties.

    Sequences and frames of a video come in one order of time, a sequence by its end, in one pass that pairs nothing: whatever the length
    of a sequence, it is shuffled as one row.
    """
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    spans = found.withColumns({"start_ms": F.element_at("path", 1), "end_ms": F.element_at("path", -1)})
    keys = ["task_idx", "video_id"]
    frames = scores.select(*keys, F.col("ts_ms").cast("long").alias("_time"), mean.cast("double").alias("_mean"))
    ends = spans.select(*keys, F.col("end_ms").alias("_time"), F.col("start_ms").alias("_start"), F.struct(*spans.columns).alias("_row"))
    rows = frames.unionByName(ends.filter("_start is not null"), allowMissingColumns=True).filter("task_idx is not null and video_id is not null and _time is not null")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_time", F.col("_start").isNotNull())
    best = ordered.mapInArrow(_highest_inside, T.StructType([*ends.select("_row").schema, T.StructField("best_ms", T.LongType()), T.StructField("best_score", T.DoubleType())]))
    return best.select("_row.*", "best_ms", "best_score")


def _highest_inside(batches):
    """Of rows in order of video and time: each sequence's _row with the time and the mean of the highest frame since its start.

    Held are only the frames of the video that no later one exceeds; their means fall, so the first of them in a sequence is its highest.
    """
    times, ranks, means, last = [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        videos = [batch.column(k) for k in ("task_idx", "video_id")]
        fresh = np.ones(batch.num_rows, dtype=bool)
        fresh[1:] = np.any([pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False) for v in videos], axis=0)
        fresh[0], last = last != [v[0].as_py() for v in videos], [v[-1].as_py() for v in videos]
        mean = batch.column("_mean")
        own = pc.fill_null(mean, 0.0).to_numpy(zero_copy_only=False)
        # Doubles as integers of the same order: null lowest, NaN highest.
        bits = np.where(np.isnan(own), np.nan, own + 0.0).view(np.int64)
        rank = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
        rank[mean.is_null().to_numpy(zero_copy_only=False)] = -(2**63)
        kept, at, score = [], [], []
        for i, (new, time, start, r, m) in enumerate(zip(fresh.tolist(), batch.column("_time").to_pylist(), batch.column("_start").to_pylist(), rank.tolist(), mean.to_pylist())):
            if new:
                times, ranks, means = [], [], []
            if start is None:
                while ranks and ranks[-1] < r:
                    times.pop(), ranks.pop(), means.pop()
                times.append(time), ranks.append(r), means.append(m)
            elif (first := bisect_left(times, start)) < len(times):
                kept.append(i), at.append(times[first]), score.append(means[first])
        taken = batch.column("_row").take(pa.array(kept, type=pa.int64()))
        yield pa.RecordBatch.from_arrays([taken, pa.array(at, type=pa.int64()), pa.array(score, type=pa.float64())], names=["_row", "best_ms", "best_score"])


def chosen_moment(mode: str, target: Column | None = None) -> Column:
    """The moment of a sequence by position; a target scene inside the sequence counts first, others don't."""
    path, size = F.col("path"), F.size("path")
    by_mode = {
        "first": F.element_at(path, 1),
        "second": F.when(size > 1, F.get(path, F.lit(1))).otherwise(F.element_at(path, 1)),
        "best": F.col("best_ms"),
        "median": F.get(path, F.floor(size / 2).cast("int")),
    }.get(mode, F.floor((F.element_at(path, 1) + F.element_at(path, -1)) / 2).cast("long"))
    if target is None:
        return by_mode
    index = F.when(target < -1, size + target).otherwise(target)
    return F.when((target != -1) & (target < size) & (index >= 0), F.get(path, index)).otherwise(by_mode)


def chosen_edge(mode: str, target: Column | None = None) -> Column:
    """1 if the moment is its sequence's first frame, -1 if it is its last, otherwise 0; only the former two can slide.

    The place in the sequence counts, not the time: a middle never slides, nor does a target counted from the end.
    """
    path, size = F.col("path"), F.size("path")
    by_mode = {
        "first": F.lit(0),
        "second": F.when(size > 1, 1).otherwise(0),
        "best": (F.array_position(path, F.col("best_ms")) - 1).cast("int"),
        "median": F.floor(size / 2).cast("int"),
    }.get(mode, F.lit(-1))
    index = by_mode if target is None else F.when((target != -1) & (target < size) & (target >= -size), target).otherwise(by_mode)
    return F.when(size < 2, 0).when(index == 0, 1).when(index == size - 1, -1).otherwise(0)


def snapped(moments: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_ms: the frame of the video nearest to moment_ms, the first on ties; moments without path, of videos that have frames."""
    times = frames.select("video_id", "ts_ms", F.col("ts_ms").alias("frame_no"))
    found = with_nearest(moments.drop("path"), "moment_ms", times).filter(F.col("near").isNotNull())
    return found.withColumn("frame_ms", F.col("near.ts_ms").cast("long")).drop("near")


def slid(moments: DataFrame, frames: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Move a chosen first frame right, or a chosen last frame left, over frames that look like it.

    moments: key, video_id, start_ms, end_ms, frame_ms, edge (see chosen_edge); frames: video_id, ts_ms, emb.  The walk ends at the
    first frame whose cosine to the fixed start is below the threshold, or at the interval's end.
    """
    own = frames.select("video_id", F.col("ts_ms").alias("frame_ms"), F.col("emb").alias("anchor"))
    near = frames.select("video_id", F.col("ts_ms").alias("at"), "emb")
    walks = moments.filter("edge <> 0").select("key", "video_id", "frame_ms", "edge", *[F.when(F.col("edge") == e, F.col("frame_ms")).otherwise(F.col(c)).alias(c) for e, c in ((1, "start_ms"), (-1, "end_ms"))])
    rows = within(walks.filter("start_ms <= end_ms"), near, ["video_id"]).join(own, ["video_id", "frame_ms"])
    rows = rows.withColumn("_step", F.abs(F.col("at") - F.col("frame_ms")))
    alike = F.when((F.col("_step") == 0) | (vectors.cosine(F.col("anchor"), F.col("emb")) >= threshold), 1).otherwise(0)
    rows = rows.withColumn("_alike", alike)
    rows = rows.withColumn("_all", F.min("_alike").over(Window.partitionBy("key").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.filter("_all = 1").groupBy("key").agg(F.max_by("at", "_step").alias("slid_ms"))
    return moments.join(ends, "key", "left").withColumn("slid_ms", F.coalesce("slid_ms", "frame_ms"))
