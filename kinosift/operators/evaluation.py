"""Ranking quality and score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10)


def hit_ranks(predictions: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """task_id and the first rank that hits the answer, null without one; one row per predicted task with a label.

    A hit has the answer's video; a strict one also lies inside the answer's interval.
    """
    hit = F.col("video_id") == F.col("answer_video_id")
    if strict:
        hit = hit & F.col("frame_ms").between(F.col("answer_start_ms"), F.col("answer_end_ms"))
    return predictions.join(labels, "task_id").groupBy("task_id").agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))


def unlabelled(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """What a score leaves out: task_id and missing, which is `prediction` for a label without one and `label` the other way round."""
    predicted, known = predictions.select("task_id").distinct(), labels.select("task_id").distinct()
    left = known.join(predicted, "task_id", "left_anti").withColumn("missing", F.lit("prediction"))
    return left.unionByName(predicted.join(known, "task_id", "left_anti").withColumn("missing", F.lit("label")))


def submitted_videos(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """task_id and its predicted videos by rank; a task without a submission has none."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "video_id"))), lambda x: x["video_id"])
    held = predictions.groupBy("task_id").agg(ordered.alias("videos"))
    return tasks.select("task_id").join(held, "task_id", "left").withColumn("videos", F.coalesce("videos", F.array().cast("array<string>")))


def summary(ranks: DataFrame, tasks: int) -> DataFrame:
    """Mean reciprocal rank and recall at the cuts over the number of submitted tasks."""
    recalls = [(F.coalesce(F.sum((F.col("hit_rank") <= k).cast("int")), F.lit(0)) / F.lit(tasks)).alias(f"recall_{k}") for k in CUTS]
    return ranks.agg((F.coalesce(F.sum(1 / F.col("hit_rank")), F.lit(0.0)) / F.lit(tasks)).alias("mrr"), *recalls)


def leaderboard(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per submission over distinct videos: hits, top1, mrr by all predicted tasks, evaluated annotations."""
    first = predictions.groupBy("submission", "task_id", "video_id").agg(F.min("rank").alias("rank"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("submission", "task_id").orderBy("rank")))
    answers = annotations.filter(F.col("video_id").isNotNull()).withColumnRenamed("video_id", "answer")
    tasks = predictions.groupBy("submission").agg(F.countDistinct("task_id").alias("tasks"))
    hits = place.join(answers, "task_id").filter("video_id = answer").groupBy("submission").agg(F.count(F.lit(1)).alias("hits"), F.sum((F.col("place") == 1).cast("long")).alias("top1"), F.sum(1 / F.col("place")).alias("gain"))
    evaluated = answers.agg(F.count(F.lit(1)).alias("evaluated"))
    rows = tasks.join(hits, "submission", "left").crossJoin(F.broadcast(evaluated))
    return rows.select("submission", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("top1", F.lit(0)).alias("top1"), F.round(F.coalesce("gain", F.lit(0.0)) / F.col("tasks"), 4).alias("mrr"), "evaluated")


def task_status(tasks: DataFrame, annotations: DataFrame) -> DataFrame:
    """pending without an annotation, skipped with a null one, annotated otherwise."""
    rows = tasks.join(annotations.withColumn("there", F.lit(True)), "task_id", "left")
    return rows.select("task_id", F.when(F.col("there").isNull(), "pending").when(F.col("video_id").isNull(), "skipped").otherwise("annotated").alias("status"))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins between the extremes; the last bin holds the maximum."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def spread(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.avg(column).alias("mean"), F.var_pop(column).alias("variance"))


def min_rank(order: Window, column: str = "rank"):
    """The rank that equal values share, the lowest."""
    return F.rank().over(order).alias(column)


def rolled_up(scores: DataFrame) -> DataFrame:
    """Task totals: the mean of the sentences' means of their segments."""
    sentences = scores.groupBy("task_idx", "sent_idx").agg(F.avg("sim").alias("sentence"))
    return sentences.groupBy("task_idx").agg(F.avg("sentence").alias("total"))


def object_counts(frames: DataFrame) -> DataFrame:
    """How often each object was seen in each frame."""
    return frames.select("frame_id", F.explode("objects").alias("object")).groupBy("frame_id", "object").agg(F.count(F.lit(1)).alias("n"))


def coverage(texts: DataFrame) -> DataFrame:
    """Percentage of texts that aren't empty."""
    return texts.agg((100 * F.avg(F.when(F.coalesce(F.col("text"), F.lit("")) != "", 1.0).otherwise(0.0))).alias("coverage"))
