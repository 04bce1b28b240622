"""Queries of readers and writers: the standard tables go to files of each format and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinosift.sources import files, sinks
from kinosift.sources.scratch import shared_path
from kinosift.sources.standard import joined, table
from kinosift.streaming.incremental import index_new

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _text_file(rows, path: str) -> str:
    """One text file of the column value in the order of the column at; a report, so it is small."""
    rows.orderBy("at").coalesce(1).select("value").write.text(path)
    return path


@query("SELECT row_number() OVER (ORDER BY item_id DESC) - 1 AS task_idx, 't' || item_id AS task_id, text AS description, CASE WHEN item_id % 2 = 0 THEN item_id % 7 ELSE 10 END AS max_predictions FROM benchmark QUALIFY task_idx < 30")
def task_file(spark, sf_dir):
    """The first tasks in the order of the file."""
    limit = F.when(F.col("item_id") % 2 == 0, F.col("item_id") % 7)
    lines = F.to_json(F.struct(F.concat(F.lit("t"), "item_id").alias("task_id"), F.col("text").alias("description"), limit.alias("max_predictions")))
    path = _text_file(table(spark, sf_dir, "benchmark").select((-F.col("item_id")).alias("at"), lines.alias("value")), shared_path(spark, "tasks"))
    return files.tasks(spark, path, 30).select(F.col("task_idx").cast("long").alias("task_idx"), "task_id", "description", F.col("max_predictions").cast("long").alias("max_predictions"))


@query("""SELECT 't' || item_id AS task_id, 'a "b", ' || text AS description, (item_id * 10)::INT AS answer_start_ms, item_id / 4.0 AS confidence FROM benchmark""")
def label_file(spark, sf_dir):
    """Labels with quotes, commas and line breaks inside."""
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), i).alias("task_id"), F.concat(F.lit('a "b", '), "text").alias("description"), F.lit("v").alias("answer_video_id"), (i * 10).alias("answer_start_ms"), (i * 10 + 5).alias("answer_end_ms"), (i / 4.0).alias("confidence"), (i % 4).alias("description_quartile"))
    path = shared_path(spark, "labels")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return files.labels(spark, path).select("task_id", "description", "answer_start_ms", "confidence")


@query("SELECT 't' || task AS task_id, n AS rank, 'v' || (task * n) AS video_id, (1000 * n)::BIGINT AS frame_ms FROM (SELECT p_partkey % 50 AS task, max(p_partkey) AS last FROM part GROUP BY ALL), range(1, 4) r(n) WHERE n <= 1 + last % 3")
def submission_file(spark, sf_dir):
    """A task that comes several times in a submission counts as it was told last."""
    n = F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("p_partkey") % 3))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("task"), n.alias("n"))
    result = F.struct(F.col("n").alias("rank"), F.concat(F.lit("v"), F.col("task") * F.col("n")).alias("video_id"), (1000 * F.col("n")).alias("frame_ms"))
    tasks = rows.groupBy("p_partkey", "task").agg(F.array_sort(F.collect_list(result)).alias("results"))
    whole = tasks.agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("t"), "task").alias("task_id"), "results"))).alias("all"))
    value = F.to_json(F.struct(F.transform("all", lambda x: F.struct(x["task_id"].alias("task_id"), x["results"].alias("results"))).alias("predictions")))
    path = _text_file(whole.select(F.lit(0).alias("at"), value.alias("value")), shared_path(spark, "submission"))
    return files.submission(spark, path).select("task_id", F.col("rank").cast("long").alias("rank"), "video_id", "frame_ms")


@query("SELECT 'v' || user_id AS video_id, event_id::INT AS ts_ms, CASE WHEN event_id % 2 = 0 THEN event_type END AS ocr, 'a|' || event_type AS objects FROM events WHERE event_id % 10 <> 0")
def metadata_file(spark, sf_dir):
    """Lines of metadata; every tenth isn't JSON and is skipped."""
    seen = F.struct(F.concat(F.lit("v"), "user_id").alias("video_id"), F.col("event_id").alias("ts_ms"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("ocr"), F.array(F.lit("a"), "event_type").alias("objects"))
    lines = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken {"), "event_type")).otherwise(F.to_json(seen))
    path = shared_path(spark, "metadata")
    table(spark, sf_dir, "events").select(lines.alias("value")).write.text(path)
    return files.metadata(spark, path).select("video_id", "ts_ms", "ocr", joined("objects").alias("objects"))


@query("""SELECT 'v' || conv_id AS video_stem, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seg_no, turn::DOUBLE AS start, turn + 0.5::DOUBLE AS "end", text FROM conversations""")
def transcript_file(spark, sf_dir):
    """One map from videos to their segments."""
    segment = F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + F.lit(0.5)).alias("end"), "text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("all"))
    whole = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("v"), "conv_id"), "all"))).alias("m"))
    path = _text_file(whole.select(F.lit(0).alias("at"), F.to_json("m").alias("value")), shared_path(spark, "transcripts"))
    return files.transcripts(spark, path)


@query("SELECT CASE page_id % 3 WHEN 0 THEN 'v3c1' WHEN 1 THEN 'v3c2' ELSE 'v3c' END || '_' || page_id AS video_id FROM pages")
def video_list_file(spark, sf_dir):
    """A list of paths with blank lines between them."""
    root = F.when(F.col("page_id") % 3 == 0, "/data/V3C1/").when(F.col("page_id") % 3 == 1, "/x/v3c2/").otherwise("/y/")
    path = shared_path(spark, "list")
    table(spark, sf_dir, "pages").select(F.concat(root, "page_id", F.lit(".mp4\n")).alias("value")).write.text(path)
    return files.video_list(spark, path).select("video_id")


@query("SELECT o_custkey % 40 AS video_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def incremental_index(spark, sf_dir):
    """New files are taken up once each, in two rounds."""
    source, target, progress = (shared_path(spark, tag) for tag in ("arrivals", "index", "progress"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("video_id"), F.col("o_totalprice").alias("price"), "o_orderkey")
    for part in (0, 1):
        rows.filter(F.col("video_id") % 2 == part).select("video_id", "price").write.mode("append").parquet(source)
        index_new(spark, source, "video_id long, price double", target, progress, lambda df: df)
    return spark.read.parquet(target).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("SELECT 'v' || page_id AS video_id, 'TypeError: ' || page_id AS error FROM pages WHERE page_id % 4 = 0")
def failure_log(spark, sf_dir):
    path = shared_path(spark, "failures")
    error = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("TypeError: "), "page_id"))
    sinks.write_failures(table(spark, sf_dir, "pages").select(F.concat(F.lit("v"), "page_id").alias("video_id"), error.alias("error")), path)
    return spark.read.csv(path, sep="\t", schema="video_id string, error string")


@query("SELECT n_name AS name, n_nationkey::INT AS number FROM nation")
def csv_report(spark, sf_dir):
    path = shared_path(spark, "report")
    sinks.write_csv(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("number")), path)
    return spark.read.csv(path, header=True, schema="name string, number int")
