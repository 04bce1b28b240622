"""The standard tables seen as frames, queries and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = 20
PER_VIDEO = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, video_id, frame_no, ts_ms, emb: 25 frames a video, one a second."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("frame_id"),
        F.floor(F.col("vec_id") / PER_VIDEO).cast("long").alias("video_id"),
        (F.col("vec_id") % PER_VIDEO).cast("int").alias("frame_no"),
        ((F.col("vec_id") % PER_VIDEO) * 1000).cast("long").alias("ts_ms"),
        F.col("embedding").cast("array<double>").alias("emb"),
        "label",
    )


def queries(spark: SparkSession, sf_dir: str, segments: int = 1) -> DataFrame:
    """query_id, task_idx, sent_idx, seg_idx, vec: 20 tasks of three scenes, whose vectors are rows of embeddings."""
    ids = spark.range(TASKS).select(F.col("id").alias("task_idx"), F.posexplode(F.array(F.lit(0), F.lit(3), F.lit(5))).alias("sent_idx", "step"))
    ids = ids.select("task_idx", "sent_idx", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("seg_idx"), "step")
    ids = ids.withColumn("vec_id", 7 * F.col("task_idx") + F.col("step") + 11 * F.col("seg_idx"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    query_id = (F.col("task_idx") * 100 + F.col("sent_idx") * 10 + F.col("seg_idx")).cast("long")
    return rows.join(F.broadcast(ids), "vec_id").select(query_id.alias("query_id"), "task_idx", "sent_idx", "seg_idx", "vec")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text of benchmark passages and turns."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text")
    return items.unionByName(turns)


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_idx, video_id, ts_ms, s: events as frames of their user's video with three scene scores."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("ts_ms", ms)
    part = lambda k: F.avg(F.pmod(F.col("event_id") * k, F.lit(101)) / 100.0)
    rows = rows.groupBy(F.col("user_id").alias("video_id"), "ts_ms").agg(part(7).alias("a"), part(13).alias("b"), part(29).alias("c"))
    return rows.select(F.lit(0).alias("task_idx"), "video_id", "ts_ms", F.array("a", "b", "c").alias("s"))


def joined(values: str | Column) -> Column:
    """An array as one string, so that results compare by value."""
    return F.array_join(F.col(values) if isinstance(values, str) else values, "|")


# The same adapters in SQL.
SQL_FRAMES = "frames AS (SELECT vec_id AS frame_id, (vec_id // 25)::BIGINT AS video_id, (vec_id % 25)::INT AS frame_no, ((vec_id % 25) * 1000)::BIGINT AS ts_ms, embedding::DOUBLE[] AS emb, label FROM embeddings)"


def sql_queries(segments: int = 1) -> str:
    return f"""queries AS (SELECT (t.i * 100 + s.p * 10 + g.i)::BIGINT AS query_id, t.i AS task_idx, s.p AS sent_idx, g.i AS seg_idx, e.embedding::DOUBLE[] AS vec
  FROM range({TASKS}) t(i), (VALUES (0, 0), (1, 3), (2, 5)) s(p, step), range({segments}) g(i), embeddings e WHERE e.vec_id = 7 * t.i + s.step + 11 * g.i)"""


SQL_SIMS = "sims AS (SELECT q.query_id, f.frame_id, 0.8 * list_dot_product(q.vec, f.emb) AS sim FROM queries q, frames f)"
SQL_EVENTS = """scored AS (SELECT 0 AS task_idx, user_id AS video_id, (epoch_us(ts) // 1000)::BIGINT AS ts_ms,
  avg((event_id * 7 % 101) / 100.0::DOUBLE) AS a, avg((event_id * 13 % 101) / 100.0::DOUBLE) AS b, avg((event_id * 29 % 101) / 100.0::DOUBLE) AS c FROM events GROUP BY ALL)"""
