"""Similarity, running top-k and fusion of sub-query scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinosift.functions import vectors

SCALE = 0.8
#: About the values that a broadcast block of queries holds; more queries are dealt in several blocks.
BLOCK_VALUES = 8_000_000
FRAME_ROWS = 2_048


def similarity(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """query_id, frame_id, sim: 0.8 times the mean over models of the dot products, as expressions.

    queries: query_id, model, vec; frames: frame_id, model, emb.  The vectors of a frame are put together once, and each block of the stated query
    set is broadcast to them; no pair is shuffled.  A pair counts the models that both have; similarity_models gives the same but for the last digits.
    """
    of = lambda rows, key, vector, name: rows.filter("model is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", F.col(vector).alias("v")))).alias(name))
    asked, seen = of(queries, "query_id", "vec", "_asked"), of(frames, "frame_id", "emb", "_seen")
    dots = F.flatten(F.transform("_seen", lambda f: F.transform(F.filter("_asked", lambda q: q["model"] == f["model"]), lambda q: vectors.dot(q["v"], f["v"]))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")))
    mean = F.aggregate(dots, start, add, lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]))
    blocks, out = max(1, _block_count(queries)), None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        pairs = seen.crossJoin(F.broadcast(part)).filter(F.arrays_overlap("_seen.model", "_asked.model"))
        scored = pairs.select("query_id", "frame_id", (F.lit(SCALE) * mean).alias("sim"))
        out = scored if out is None else out.unionByName(scored)
    return out


def similarity_models(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """The same as block products: the mean of products is one product of the vectors end to end, so frames are put together once.

    Every frame and query needs all models; a frame that lacks one fails the run.
    """
    models = queries.select("model").distinct().count()
    return similarity_blocks(stacked(queries, "query_id", "vec"), stacked(frames, "frame_id", "emb"), SCALE / max(1, models))


def stacked(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per key with the vectors of all its models end to end, in the order of their names, and their number."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", vector))).alias("_all"))
    return found.select(key, F.flatten(F.transform("_all", lambda x: x[vector])).alias(vector), F.size("_all").alias("models"))


def _block_count(queries: DataFrame) -> int:
    """In how many blocks of about BLOCK_VALUES values the query set comes; none if it is empty."""
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    return -(-int(shape["n"]) * int(shape["width"] or 1) // BLOCK_VALUES)


def _blocks(queries: DataFrame):
    """The query set in broadcast blocks of about BLOCK_VALUES values; a query_id is in one of them."""
    spark = queries.sparkSession
    blocks = _block_count(queries)
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "vec").collect()
        if part:
            yield spark.sparkContext.broadcast((np.array([r["query_id"] for r in part]), np.array([r["vec"] for r in part], dtype=np.float64)))


def _products(batches, own: np.ndarray, matrix: np.ndarray, scale: float):
    """Frame ids and the scores of all queries, for a bounded number of frames at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, FRAME_ROWS):
            some = batch.slice(at, FRAME_ROWS)
            frame = np.asarray(some.column(0))
            yield frame, scale * (np.asarray(some.column(1).flatten(), dtype=np.float64).reshape(len(frame), -1) @ matrix.T)


def similarity_blocks(queries: DataFrame, frames: DataFrame, scale: float = SCALE) -> DataFrame:
    """The same over one model, or over stacked ones, as matrix products of Arrow blocks of frames with blocks of queries.

    A stated query set against all frames: the queries are brought to the driver in blocks of bounded size, and
    each block is broadcast to one pass over the frames.  For n stacked models hand in a scale of SCALE / n.
    """
    out = None
    for block in _blocks(queries):

        def run(batches, block=block):
            own, matrix = block.value
            for frame, values in _products(batches, own, matrix, scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(own, len(frame))), pa.array(np.repeat(frame, len(own))), pa.array(values.ravel())], names=["query_id", "frame_id", "sim"])

        scored = frames.select("frame_id", "emb").mapInArrow(run, "query_id long, frame_id long, sim double")
        out = scored if out is None else out.unionByName(scored)
    return frames.sparkSession.createDataFrame([], "query_id long, frame_id long, sim double") if out is None else out


def top_similar(queries: DataFrame, frames: DataFrame, k: int, scale: float = SCALE) -> DataFrame:
    """The k best frames of each query with their ranks, as top_frames(similarity_blocks(...), k) gives them.

    Each task keeps the k best of its own frames before anything leaves it, so what is shuffled is queries times k times tasks.
    """
    out = None
    for block in _blocks(queries):

        def run(batches, block=block):
            own, matrix = block.value
            ids, best = np.zeros((len(own), 0), dtype=np.int64), np.zeros((len(own), 0))
            for frame, values in _products(batches, own, matrix, scale):
                ids = np.concatenate([ids, np.broadcast_to(frame, (len(own), len(frame)))], axis=1)
                best = np.concatenate([best, values.T], axis=1)
                if best.shape[1] > k:
                    order = np.lexsort((ids, -best), axis=1)[:, :k]
                    ids, best = np.take_along_axis(ids, order, axis=1), np.take_along_axis(best, order, axis=1)
            if ids.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ids.shape[1])), pa.array(ids.ravel()), pa.array(best.ravel())], names=["query_id", "frame_id", "sim"])

        scored = frames.select("frame_id", "emb").mapInArrow(run, "query_id long, frame_id long, sim double")
        out = scored if out is None else out.unionByName(scored)
    empty = frames.sparkSession.createDataFrame([], "query_id long, frame_id long, sim double")
    return top_frames(empty if out is None else out, k)


def top_frames(sims: DataFrame, k: int) -> DataFrame:
    """The k best frames of each query; equal scores go by frame_id.  Ranks are limited before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "frame_id")
    return sims.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def densified(sims: DataFrame, queries: DataFrame, frames: DataFrame) -> DataFrame:
    """Every sub-query with every frame that some sub-query of its task has; what is missing scores 0.

    Frames that no sub-query of the task has would score 0 throughout and are left out.
    """
    held = sims.join(queries.select("query_id", "task_idx"), "query_id").select("task_idx", "frame_id").distinct()
    every = held.join(queries.select("task_idx", "query_id", "sent_idx", "seg_idx"), "task_idx")
    return every.join(sims.select("query_id", "frame_id", "sim"), ["query_id", "frame_id"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def fuse(mode: str, main_weight: float = 2.0) -> Column:
    """Aggregate of the segments' scores of one scene and frame; columns sim, seg_idx.

    harmonic weighs the first segment by main_weight where there are several.
    """
    if mode == "min":
        return F.min("sim")
    if mode == "mean":
        return F.avg("sim")
    shifted = F.col("sim") + 1 + 1e-6
    several = F.count(F.lit(1)) > 1
    main = F.when(F.col("seg_idx") == 0, F.lit(main_weight)).otherwise(F.lit(1.0))
    return F.when(several, F.sum(main) / F.sum(main / shifted)).otherwise(F.count(F.lit(1)) / F.sum(1 / shifted)) - 1


def scene_scores(dense: DataFrame, mode: str = "harmonic", main_weight: float = 2.0) -> DataFrame:
    """task_idx, sent_idx, frame_id, score."""
    return dense.groupBy("task_idx", "sent_idx", "frame_id").agg(fuse(mode, main_weight).alias("score"))


def best_frame_per_video(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean over the scenes, and the best frame of each task and video; the first in order on ties."""
    scored = scenes.groupBy("task_idx", "frame_id").agg(F.avg("score").alias("sim")).join(frames.select("frame_id", "video_id", "ts_ms"), "frame_id")
    best = F.max_by(F.struct("frame_id", "ts_ms", "sim"), F.struct("sim", -F.col("frame_id"))).alias("b")
    return scored.groupBy("task_idx", "video_id").agg(best).select("task_idx", "video_id", F.col("b.frame_id").alias("frame_id"), F.col("b.ts_ms").alias("frame_ms"), F.col("b.sim").alias("sim"))


def categories(vectors_of: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The k categories (at most a few dozen rows, so broadcast) of highest cosine for each id."""
    pairs = vectors_of.crossJoin(F.broadcast(texts)).select("id", "category", vectors.cosine(F.col("vec"), F.col("cat_vec")).alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "category")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def voted(labels: DataFrame, reach: int = 2) -> DataFrame:
    """Majority label of a frame and its neighbours in the video; the smallest label on ties."""
    order = Window.partitionBy("video_id").orderBy("frame_no").rowsBetween(-reach, reach)
    held = labels.withColumn("_near", F.collect_list("category").over(order))
    counted = F.transform(F.array_distinct("_near"), lambda c: F.struct(F.size(F.filter("_near", lambda x: x == c)).alias("n"), (-c).alias("c")))
    return held.withColumn("voted", -F.array_max(counted)["c"]).drop("_near")
