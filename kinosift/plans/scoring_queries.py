"""Queries of vectors, similarity and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinosift.functions import vectors
from kinosift.operators import scoring
from kinosift.sources.standard import SQL_FRAMES, SQL_SIMS, frames, queries, sql_queries, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


_BASE = f"WITH {SQL_FRAMES}, {sql_queries()}, {SQL_SIMS}"
_SEGS = f"WITH {SQL_FRAMES}, {sql_queries(2)}, {SQL_SIMS}, held AS (SELECT s.*, q.task_idx, q.sent_idx, q.seg_idx FROM sims s JOIN queries q USING (query_id))"


@query(f"WITH {SQL_FRAMES}, {sql_queries()} SELECT q.query_id, f.frame_id, round(0.8 * (list_dot_product(q.vec, f.emb) + list_dot_product(q.vec, list_reverse(f.emb))) / 2, 6) AS sim FROM queries q, frames f")
def similarity_dot(spark, sf_dir):
    """Two models, the second with reversed frame vectors."""
    q, f = queries(spark, sf_dir), frames(spark, sf_dir)
    both = f.withColumn("model", F.lit("a")).unionByName(f.withColumn("model", F.lit("b")).withColumn("emb", F.reverse("emb")))
    asked = q.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return scoring.similarity(asked, both).withColumn("sim", F.round("sim", 6))


@query(f"WITH {SQL_FRAMES}, {sql_queries()} SELECT q.query_id, f.frame_id, round(0.8 * (list_dot_product(q.vec, f.emb) + list_dot_product(q.vec, list_reverse(f.emb))) / 2, 6) + 0.0 AS sim FROM queries q, frames f")
def similarity_models(spark, sf_dir):
    """The same by block products over the models' vectors end to end; a zero has no sign here."""
    q, f = queries(spark, sf_dir), frames(spark, sf_dir)
    both = f.withColumn("model", F.lit("a")).unionByName(f.withColumn("model", F.lit("b")).withColumn("emb", F.reverse("emb")))
    asked = q.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return scoring.similarity_models(asked, both).withColumn("sim", F.round("sim", 6) + 0.0)


@query(_BASE + " SELECT query_id, frame_id, round(sim, 6) AS sim FROM sims")
def similarity_blocks(spark, sf_dir):
    return scoring.similarity_blocks(queries(spark, sf_dir), frames(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query(f"WITH {SQL_FRAMES}, {sql_queries()} SELECT q.query_id, f.frame_id, round(list_dot_product(q.vec, f.emb) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(f.emb, f.emb)) + 1e-6), 6) AS cos FROM queries q, frames f")
def cosine(spark, sf_dir):
    """The stated queries, broadcast, against every frame."""
    pairs = frames(spark, sf_dir).crossJoin(F.broadcast(queries(spark, sf_dir)))
    return pairs.select("query_id", "frame_id", F.round(vectors.cosine(F.col("vec"), F.col("emb")), 6).alias("cos"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS len, round(e[1] * 3 / sqrt(list_dot_product(list_transform(e, lambda x: x * 3), list_transform(e, lambda x: x * 3))), 6) AS head FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def l2_normalize(spark, sf_dir):
    rows = frames(spark, sf_dir)
    tripled = vectors.normalised(F.transform("emb", lambda x: x * 3))
    return rows.select(F.col("frame_id").alias("vec_id"), F.round(vectors.norm(F.col("emb")), 6).alias("len"), F.round(tripled[0], 6).alias("head"))


@query(_BASE + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, frame_id) AS rank FROM sims) SELECT query_id, frame_id, rank::INT AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 50")
def topk_frames(spark, sf_dir):
    return scoring.top_similar(queries(spark, sf_dir), frames(spark, sf_dir), 50).withColumn("sim", F.round("sim", 6))


def _fused(mode):
    def run(spark, sf_dir):
        q = queries(spark, sf_dir, 2)
        held = scoring.similarity_blocks(q, frames(spark, sf_dir)).join(F.broadcast(q.drop("vec")), "query_id")
        return scoring.scene_scores(held, mode, 3.0).withColumn("score", F.round("score", 6))

    return run


_FUSED = _SEGS + " SELECT task_idx, sent_idx, frame_id, round({}, 6) AS score FROM held GROUP BY ALL"
for _name, _mode, _sql in (
    ("min_fusion", "min", "min(sim)"),
    ("mean_fusion", "mean", "avg(sim)"),
    ("harmonic_fusion", "harmonic", "4.0 / sum(CASE WHEN seg_idx = 0 THEN 3.0 ELSE 1.0 END / (sim + 1 + 1e-6)) - 1"),
):
    QUERIES[_name], ORACLES[_name] = _fused(_mode), _FUSED.format(_sql)


_TOP = ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, frame_id) AS rank FROM sims) WHERE rank <= 40)"
_DENSE = ", dense AS (SELECT q.task_idx, q.sent_idx, q.seg_idx, q.query_id, f.frame_id, coalesce(t.sim, 0) AS sim FROM (SELECT DISTINCT q.task_idx, t.frame_id FROM top t JOIN queries q USING (query_id)) f JOIN queries q USING (task_idx) LEFT JOIN top t ON t.query_id = q.query_id AND t.frame_id = f.frame_id)"


@query(_BASE + _TOP + _DENSE + " SELECT query_id, frame_id, round(sim, 6) AS sim FROM dense")
def sparse_densify(spark, sf_dir):
    q, f = queries(spark, sf_dir), frames(spark, sf_dir)
    dense = scoring.densified(scoring.top_similar(q, f, 40), q, f)
    return dense.select("query_id", "frame_id", F.round("sim", 6).alias("sim"))


@query(_BASE + """, scenes AS (SELECT q.task_idx, s.frame_id, avg(s.sim) AS sim FROM sims s JOIN queries q USING (query_id) GROUP BY ALL),
r AS (SELECT s.*, f.video_id, f.ts_ms, row_number() OVER (PARTITION BY task_idx, video_id ORDER BY round(sim, 9) DESC, frame_id) AS n FROM scenes s JOIN frames f USING (frame_id))
SELECT task_idx, video_id, frame_id, ts_ms AS frame_ms, round(sim, 6) AS sim FROM r WHERE n = 1""")
def scene_mean_fusion(spark, sf_dir):
    q, f = queries(spark, sf_dir), frames(spark, sf_dir)
    held = scoring.similarity_blocks(q, f).join(F.broadcast(q.drop("vec")), "query_id")
    scenes = scoring.scene_scores(held, "mean").withColumn("score", F.round("score", 12))
    return scoring.best_frame_per_video(scenes, f).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SQL_FRAMES}, u AS (SELECT frame_id, video_id, frame_no, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM frames),
w AS (SELECT a.frame_id, a.i, sum(b.x * exp(-pow(b.frame_no - a.frame_no, 2) / 2)) / sum(exp(-pow(b.frame_no - a.frame_no, 2) / 2)) AS x
  FROM u a JOIN u b ON a.video_id = b.video_id AND a.i = b.i AND abs(a.frame_no - b.frame_no) <= 2 GROUP BY ALL),
n AS (SELECT frame_id, sqrt(sum(x * x)) AS len FROM w GROUP BY ALL)
SELECT frame_id, round(sum(x / len * i), 5) AS mark, round(max(CASE WHEN i = 1 THEN x / len END), 5) AS head FROM w JOIN n USING (frame_id) GROUP BY ALL""")
def temporal_smoothing(spark, sf_dir):
    rows = vectors.smoothed(frames(spark, sf_dir), 5, 1.0)
    mark = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("frame_id", F.round(mark, 5).alias("mark"), F.round(F.col("emb")[0], 5).alias("head"))


_CATS = "cats AS (SELECT label AS category, embedding::DOUBLE[] AS cat_vec FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))"
_COS = "list_dot_product({0}, cat_vec) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product(cat_vec, cat_vec)) + 1e-6)"


def _categories(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return first.select(F.col("label").alias("category"), F.col("v").cast("array<double>").alias("cat_vec"))


@query(f"WITH {sql_queries()}, {_CATS}, s AS (SELECT query_id AS id, category, {_COS.format('vec')} AS sim FROM queries, cats), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, category) AS rank FROM s) SELECT id, category, rank::INT AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 5")
def query_categories(spark, sf_dir):
    asked = queries(spark, sf_dir).select(F.col("query_id").alias("id"), "vec")
    return scoring.categories(asked, _categories(spark, sf_dir), 5).select("id", "category", "rank", F.round("sim", 6).alias("sim"))


@query(f"""WITH {SQL_FRAMES}, {_CATS}, s AS (SELECT frame_id, video_id, frame_no, category, {_COS.format('emb')} AS sim FROM frames, cats),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY sim DESC, category) AS n FROM s) WHERE n = 1),
v AS (SELECT a.frame_id, b.category, count(*) AS n FROM b a JOIN b ON a.video_id = b.video_id AND abs(a.frame_no - b.frame_no) <= 2 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, category) AS k FROM v)
SELECT b.frame_id, b.category, w.category AS voted FROM b JOIN w USING (frame_id) WHERE k = 1""")
def frame_categories(spark, sf_dir):
    f = frames(spark, sf_dir)
    best = scoring.categories(f.select(F.col("frame_id").alias("id"), F.col("emb").alias("vec")), _categories(spark, sf_dir), 1)
    labels = best.join(f.select(F.col("frame_id").alias("id"), "video_id", "frame_no"), "id")
    return scoring.voted(labels).select(F.col("id").alias("frame_id"), "category", "voted")
