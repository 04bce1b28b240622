"""Queries of sources, joins, partitioning and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinosift.operators import joins
from kinosift.sources import files
from kinosift.sources.sinks import submission_json as to_json
from kinosift.sources.standard import SQL_FRAMES, frames, joined, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'v3c1' WHEN page_id % 3 = 1 THEN 'v3c2' ELSE 'v3c' END AS collection, CASE WHEN page_id % 3 = 0 THEN 'v3c1' WHEN page_id % 3 = 1 THEN 'v3c2' ELSE 'other' END || '_' || lpad(page_id::VARCHAR, 5, '0') AS video_id FROM pages")
def list_videos(spark, sf_dir):
    root = F.when(F.col("page_id") % 3 == 0, "V3C1").when(F.col("page_id") % 3 == 1, "V3C2").otherwise("Other")
    path = F.concat(F.lit("/data/"), root, F.lit("/videos/a/"), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit(".mp4"))
    return table(spark, sf_dir, "pages").select("page_id", files.collection(path).alias("collection"), files.video_id(path).alias("video_id"))


@query("SELECT event_id, round_even(event_id * 0.0005::DECIMAL(20, 6) * 1000, 0)::INT || '|' || round_even(value::DECIMAL(20, 4) * 1000, 0)::INT AS times FROM events")
def decoder_times(spark, sf_dir):
    value = F.col("value").cast("decimal(20,4)").cast("string")
    log = F.concat(F.lit("n:0 pts_time:"), (F.col("event_id") * F.expr("0.0005BD")).cast("string"), F.lit(" x\nn:1 pts_time:"), value, F.lit(" y"))
    return table(spark, sf_dir, "events").select("event_id", joined(files.frame_times(log)).alias("times"))


@query("SELECT o_custkey, array_to_string(list_transform(range(1, least(len(k), len(d)) + 1), lambda i: k[i] || '@' || d[i]), '|') AS frames FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS k, list_sort(list(o_custkey + o_orderkey % 7) FILTER (WHERE o_orderkey % 2 = 0)) AS d FROM orders GROUP BY ALL) WHERE d IS NOT NULL")
def paired_frames(spark, sf_dir):
    times = F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + F.col("o_orderkey") % 7)))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("images"), times.alias("times")).filter(F.size("times") > 0)
    pairs = F.transform(files.paired_frames(F.col("images"), F.col("times")), lambda p: F.concat_ws("@", p["image"], p["ts_ms"]))
    return rows.select("o_custkey", joined(pairs).alias("frames"))


_META = "SELECT user_id AS video_id, event_id AS ts_ms, CASE WHEN event_id % 2 = 0 THEN 'root' END AS ocr, CASE WHEN event_id % 3 = 0 THEN event_type END AS caption FROM events WHERE event_id % 5 <> 0"


@query(f"WITH a AS ({_META}), b AS (SELECT user_id AS video_id, event_id AS ts_ms, CASE WHEN event_id % 4 = 0 THEN 'later' END AS ocr, NULL::VARCHAR AS caption FROM events WHERE event_id % 7 <> 0), c AS (SELECT user_id AS video_id, event_id AS ts_ms, NULL::VARCHAR AS ocr, 'last' AS caption FROM events WHERE event_id % 11 = 0) SELECT video_id, ts_ms, coalesce(c.ocr, b.ocr, a.ocr) AS ocr, coalesce(c.caption, b.caption, a.caption) AS caption FROM a FULL JOIN b USING (video_id, ts_ms) FULL JOIN c USING (video_id, ts_ms)")
def metadata_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ts_ms"), "event_type")
    none = F.lit(None).cast("string")
    a = rows.filter("ts_ms % 5 <> 0").select("video_id", "ts_ms", F.when(F.col("ts_ms") % 2 == 0, "root").alias("ocr"), F.when(F.col("ts_ms") % 3 == 0, F.col("event_type")).alias("caption"))
    b = rows.filter("ts_ms % 7 <> 0").select("video_id", "ts_ms", F.when(F.col("ts_ms") % 4 == 0, "later").alias("ocr"), none.alias("caption"))
    c = rows.filter("ts_ms % 11 = 0").select("video_id", "ts_ms", none.alias("ocr"), F.lit("last").alias("caption"))
    return joins.merged_metadata([a, b, c], ["ocr", "caption"], ["video_id", "ts_ms"])


@query("SELECT user_id, count(*) AS n, max(json_extract_string(props, '$.page')) AS page FROM events GROUP BY user_id")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("page", F.get_json_object("props", "$.page"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("page"))


@query("SELECT a.o_orderkey AS frame_id, a.o_custkey AS left_row, b.n AS right_row FROM orders a JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) b ON a.o_orderkey = b.l_orderkey")
def model_alignment(spark, sf_dir):
    """Two sides made of different tables; the left one fails the run where a side lacks a key."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = orders.select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("left_row"))
    counts = lines.groupBy(F.col("l_orderkey").alias("frame_id")).agg(F.count(F.lit(1)).alias("right_row"))
    none = orders.join(counts, orders["o_orderkey"] == counts["frame_id"], "left_anti").select(F.col("o_orderkey").alias("frame_id"), F.lit(0).cast("long").alias("right_row"))
    return joins.aligned(left, counts.unionByName(none), ["frame_id"]).select("frame_id", "left_row", "right_row")


_SEGMENTS = "seg AS (SELECT video_id AS video_key, frame_no AS seg_no, ts_ms / 1000.0 - 0.5 AS s, ts_ms / 1000.0 + 1.0 AS e, ' said ' || frame_id || ' ' AS text FROM frames WHERE frame_no % 4 <> 3)"


@query(f"WITH {SQL_FRAMES}, {_SEGMENTS} SELECT f.video_id AS video_key, f.ts_ms, coalesce(trim(min_by(text, seg_no)), '') AS text FROM frames f LEFT JOIN seg ON seg.video_key = f.video_id AND f.ts_ms / 1000.0 BETWEEN s AND e GROUP BY ALL")
def transcript_range_join(spark, sf_dir):
    f = frames(spark, sf_dir)
    t = F.col("ts_ms") / 1000.0
    segments = f.filter("frame_no % 4 <> 3").select(F.col("video_id").alias("video_key"), F.col("frame_no").alias("seg_no"), (t - 0.5).alias("start"), (t + 1.0).alias("end"), F.concat(F.lit(" said "), "frame_id", F.lit(" ")).alias("text"))
    return joins.transcript_text(f.select(F.col("video_id").alias("video_key"), "ts_ms"), segments, 5)


@query(f"WITH {SQL_FRAMES}, p AS (SELECT event_id AS key, event_id % 30 AS video_id, event_id * 37 % 30000 AS ms FROM events), n AS (SELECT p.*, f.frame_no, f.ts_ms, row_number() OVER (PARTITION BY key ORDER BY abs(f.ts_ms - ms), frame_no) AS k FROM p LEFT JOIN frames f ON f.video_id = p.video_id) SELECT key, video_id, ms, frame_no, ts_ms FROM n WHERE k = 1")
def nearest_frame(spark, sf_dir):
    e = F.col("event_id")
    points = table(spark, sf_dir, "events").select(e.alias("key"), (e % 30).alias("video_id"), (e * 37 % 30000).alias("ms"))
    return joins.nearest(points, frames(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.unfinished(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i % 6 = 2")
def shard_mod(spark, sf_dir):
    return joins.sharded(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 6, 2)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i % 5 = 1 AND i // 5 < 700")
def shard_sparse(spark, sf_dir):
    """Sparse keys, and a limit inside the shard."""
    return joins.sharded(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 5, 1, 700)


@query("SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // ((count(*) OVER () + 19) // 20) AS chunk FROM benchmark")
def task_chunks(spark, sf_dir):
    return joins.chunked(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], 20)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem")
def row_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.positioned(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "position")


@query("SELECT l_orderkey::VARCHAR AS task_id, '{\"task_id\":\"' || l_orderkey || '\",\"results\":[' || string_agg('{\"rank\":' || l_linenumber || ',\"video_id\":\"v' || l_partkey || '\",\"frame_ms\":' || l_suppkey || '}', ',' ORDER BY l_linenumber, 'v' || l_partkey, l_suppkey) || ']}' AS value FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY l_orderkey")
def submission_json(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("v"), "l_partkey").alias("video_id"), F.col("l_suppkey").alias("frame_ms")).distinct()
    return to_json(rows)


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS caption FROM events")
def metadata_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), F.col("event_id").alias("ts_ms"), "event_type")
    held = rows.filter("event_id % 3 <> 0").select("video_id", "ts_ms", F.col("event_type").alias("caption"))
    return joins.metadata_at(rows.select("event_id", "video_id", "ts_ms"), held, ["caption"]).select("event_id", "caption")


@query("SELECT o_orderkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS description FROM orders JOIN customer ON c_custkey = o_custkey")
def task_descriptions(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    told = customers.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("description"))
    known = orders.join(customers.select("c_custkey"), orders["o_custkey"] == F.col("c_custkey"), "left_semi")
    return joins.described(known.select("o_orderkey", F.col("o_custkey").alias("task_id")), told).select(F.col("o_orderkey").alias("task_id"), "description")


@query("SELECT l_orderkey AS video_id, l_linenumber AS frame_no FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey HAVING count(*) = o_custkey % 5 + 1)")
def complete_videos(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("frame_no"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") % 5 + 1).alias("n_frames"))
    return joins.complete_videos(rows, expected)


@query("SELECT o_custkey, array_to_string(list_transform(range(1, least(len(k), CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE len(k) END) + 1), lambda i: k[i] || '@' || CASE WHEN o_custkey % 2 = 0 THEN i * 40 ELSE (i - 1) * 1000 END), '|') AS frames FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY ALL)")
def timed_frames(spark, sf_dir):
    """Three times in the log of every other video, none in the rest."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("images"))
    log = F.when(F.col("o_custkey") % 2 == 0, "pts_time:0.04 pts_time:0.08 x pts_time:0.12").otherwise("no frames")
    pairs = F.transform(files.timed_frames(F.col("images"), log), lambda p: F.concat_ws("@", p["image"], p["ts_ms"]))
    return rows.select("o_custkey", joined(pairs).alias("frames"))


@query("SELECT page_id, page_id % 4 < 2 AS whole FROM pages")
def whole_images(spark, sf_dir):
    kind = F.col("page_id") % 4
    content = F.when(kind == 0, F.unhex(F.lit("FFD8FFE000104A46494600FFD9"))).when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A0000000049454E44AE426082"))).when(kind == 2, F.unhex(F.lit("FFD8FFE000104A464946")))
    return table(spark, sf_dir, "pages").select("page_id", files.whole_image(content).alias("whole"))
