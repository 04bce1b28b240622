"""Queries of ranking quality and score statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinosift.operators import evaluation, scoring
from kinosift.sources.standard import SQL_FRAMES, SQL_SIMS, frames, queries, sql_queries, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


_SIMS = f"WITH {SQL_FRAMES}, {sql_queries()}, {SQL_SIMS}"
_TASKS = "tasks AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS rank, l_partkey % 40 AS video_id, l_suppkey * 1000 AS frame_ms FROM lineitem), labels AS (SELECT o_orderkey AS task_id, o_custkey % 40 AS answer_video_id, 10000 AS answer_start_ms, 60000 AS answer_end_ms FROM orders WHERE o_orderkey % 3 <> 0)"


def _predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select(F.col("l_orderkey").alias("task_id"), rank.alias("rank"), (F.col("l_partkey") % 40).alias("video_id"), (F.col("l_suppkey") * 1000).alias("frame_ms"))


def _labels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0")
    return rows.select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 40).alias("answer_video_id"), F.lit(10000).alias("answer_start_ms"), F.lit(60000).alias("answer_end_ms"))


def _recall(strict):
    def run(spark, sf_dir):
        predictions = _predictions(spark, sf_dir)
        ranks = evaluation.hit_ranks(predictions, _labels(spark, sf_dir), strict)
        tasks = predictions.select("task_id").distinct().count()
        return evaluation.summary(ranks, tasks).select(*[F.round(c, 6).alias(c) for c in ("mrr", "recall_1", "recall_5", "recall_10")])

    return run


for _name, _hit in (("recall_mrr", ""), ("strict_recall_mrr", " AND t.frame_ms BETWEEN l.answer_start_ms AND l.answer_end_ms")):
    QUERIES[_name] = _recall(bool(_hit))
    ORACLES[_name] = f"""WITH {_TASKS}, h AS (SELECT t.task_id, min(CASE WHEN t.video_id = l.answer_video_id{_hit} THEN rank END) AS r FROM tasks t JOIN labels l USING (task_id) GROUP BY ALL), n AS (SELECT count(DISTINCT task_id) AS n FROM tasks)
    SELECT round(coalesce(sum(1.0::DOUBLE / r), 0) / any_value(n), 6) AS mrr, round(coalesce(sum((r <= 1)::INT), 0) / any_value(n), 6) AS recall_1, round(coalesce(sum((r <= 5)::INT), 0) / any_value(n), 6) AS recall_5, round(coalesce(sum((r <= 10)::INT), 0) / any_value(n), 6) AS recall_10 FROM h, n"""


@query(f"""WITH {_TASKS}, p AS (SELECT task_id % 5 AS submission, * FROM tasks), f AS (SELECT submission, task_id, video_id, min(rank) AS rank FROM p GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY submission, task_id ORDER BY rank) AS place FROM f), n AS (SELECT submission, count(DISTINCT task_id) AS n FROM p GROUP BY ALL),
h AS (SELECT submission, count(*) AS hits, sum((place = 1)::BIGINT) AS top1, sum(1.0::DOUBLE / place) AS gain FROM d JOIN labels l ON l.task_id = d.task_id AND l.answer_video_id = d.video_id GROUP BY ALL)
SELECT n.submission, coalesce(hits, 0) AS hits, coalesce(top1, 0)::BIGINT AS top1, round(coalesce(gain, 0) / n, 4) AS mrr, (SELECT count(*) FROM labels) AS evaluated FROM n LEFT JOIN h ON h.submission = n.submission""")
def leaderboard(spark, sf_dir):
    predictions = _predictions(spark, sf_dir).withColumn("submission", F.col("task_id") % 5)
    return evaluation.leaderboard(predictions, _labels(spark, sf_dir).select("task_id", F.col("answer_video_id").alias("video_id")))


@query("SELECT doc_id AS task_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'skipped' ELSE 'annotated' END AS status FROM documents LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NULL", "l.toxic IS NULL"))
def task_status(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), F.when(F.col("toxic") == 0, F.col("quality")).alias("video_id"))
    return evaluation.task_status(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id")), marks)


@query("SELECT least(floor((value - low) / ((high - low) / 50)), 49)::INT AS bin, count(*) AS n FROM events, (SELECT min(value) AS low, max(value) AS high FROM events) GROUP BY bin")
def score_hist(spark, sf_dir):
    return evaluation.histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events")
def score_spread(spark, sf_dir):
    return evaluation.spread(table(spark, sf_dir, "events"), "value").select(F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)::INT AS rank FROM lineitem")
def minrank(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evaluation.min_rank(order))


@query(_SIMS + ", r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY sim DESC) AS rank FROM sims), top AS (SELECT * FROM r ORDER BY sim DESC, query_id, frame_id LIMIT 10) SELECT label, round(avg(rank), 6) AS avg_rank FROM top JOIN frames USING (frame_id) GROUP BY label")
def avg_rank_top10(spark, sf_dir):
    f = frames(spark, sf_dir)
    sims = scoring.similarity_blocks(queries(spark, sf_dir), f)
    rank = sims.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("sim"))))
    top = rank.orderBy(F.desc("sim"), "query_id", "frame_id").limit(10)
    return top.join(f.select("frame_id", "label"), "frame_id").groupBy("label").agg(F.round(F.avg("rank"), 6).alias("avg_rank"))


@query(_SIMS + " SELECT query_id, frame_id, round(sim, 6) AS sim FROM sims ORDER BY sims.sim DESC, query_id, frame_id LIMIT 10")
def global_top10(spark, sf_dir):
    sims = scoring.similarity_blocks(queries(spark, sf_dir), frames(spark, sf_dir))
    return sims.orderBy(F.desc("sim"), "query_id", "frame_id").limit(10).withColumn("sim", F.round("sim", 6))


@query("WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS sent_idx, avg(l_extendedprice / 7.0::DOUBLE) AS m FROM lineitem GROUP BY ALL) SELECT l_orderkey AS task_idx, round(avg(m), 3) AS total FROM s GROUP BY ALL")
def task_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_idx"), (F.col("l_linenumber") % 3).alias("sent_idx"), (F.col("l_extendedprice") / 7.0).alias("sim"))
    return evaluation.rolled_up(rows).withColumn("total", F.round("total", 3))


@query("SELECT user_id AS frame_id, event_type AS object, count(*) AS n FROM events GROUP BY ALL")
def object_counts(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("frame_id")).agg(F.collect_list("event_type").alias("objects"))
    return evaluation.object_counts(seen)


@query("SELECT round(100 * avg(CASE WHEN l_orderkey IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey")
def text_coverage(spark, sf_dir):
    """Orders as frames; those with a large item have a text, the others none."""
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("text", F.lit("said"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(large, "o_orderkey", "left")
    return evaluation.coverage(rows).select(F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_TASKS} SELECT task_id, 'prediction' AS missing FROM labels WHERE task_id NOT IN (SELECT task_id FROM tasks) UNION ALL SELECT DISTINCT task_id, 'label' FROM tasks WHERE task_id NOT IN (SELECT task_id FROM labels)")
def missing_tasks(spark, sf_dir):
    return evaluation.unlabelled(_predictions(spark, sf_dir), _labels(spark, sf_dir))


@query(f"WITH {_TASKS} SELECT o_orderkey AS task_id, coalesce(v, '') AS videos FROM orders LEFT JOIN (SELECT task_id, string_agg(video_id::VARCHAR, '|' ORDER BY rank) AS v FROM tasks WHERE task_id % 4 <> 0 GROUP BY ALL) t ON t.task_id = o_orderkey")
def submitted_videos(spark, sf_dir):
    predictions = _predictions(spark, sf_dir).filter("task_id % 4 <> 0").withColumn("video_id", F.col("video_id").cast("string"))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    return evaluation.submitted_videos(tasks, predictions).select("task_id", F.array_join("videos", "|").alias("videos"))
