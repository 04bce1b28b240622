"""Queries of sequences, suppression and the whole retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinosift.config import RetrievalConfig
from kinosift.operators import sequence, suppression
from kinosift.plans.retrieve import retrieve
from kinosift.sources.standard import SQL_EVENTS, SQL_FRAMES, SQL_SIMS, event_scores, frames, joined, queries, sql_queries

QUERIES, ORACLES = {}, {}
GAP = 6 * 3600 * 1000
PAD = 2000


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _sql_chain(scored: str, gap: int, discount: float, mode: str = "add", clip: bool = False) -> str:
    """CTEs d0, d1, d2 over scored (task_idx, video_id, ts_ms, a, b, c); chain holds the ends."""
    value = (lambda x: f"least(greatest({x}, 0.0), 1.0)") if clip else (lambda x: x)
    over = f"OVER (PARTITION BY task_idx, video_id ORDER BY ts_ms RANGE BETWEEN {gap} PRECEDING AND 1 PRECEDING)"
    out = [scored, f"d0 AS (SELECT *, {value('a')}::DOUBLE AS dp, [ts_ms] AS path, min(ts_ms) OVER (PARTITION BY task_idx, video_id) AS first_ms FROM scored)"]
    for m, c in ((1, "b"), (2, "c")):
        out.append(f"p{m} AS (SELECT *, max(CASE WHEN dp IS NOT NULL THEN {{'dp': dp, 'ts': ts_ms, 'path': path}} END) {over} AS best FROM d{m - 1})")
        if mode == "prod":
            first = ", ".join(["first_ms"] * m)
            dp, path = f"coalesce(best.dp, 0) * {value(c)}", f"list_append(CASE WHEN best.dp IS NULL THEN [{first}] ELSE best.path END, ts_ms)"
        else:
            dp, path = f"best.dp + {value(c)} * {discount**m!r}", "CASE WHEN best.dp IS NOT NULL THEN list_append(best.path, ts_ms) END"
        out.append(f"d{m} AS (SELECT * EXCLUDE (dp, path, best), {dp} AS dp, {path} AS path FROM p{m})")
    out.append("chain AS (SELECT task_idx, video_id, ts_ms, dp AS score, path, path[1] AS start_ms, path[-1] AS end_ms FROM d2 WHERE dp IS NOT NULL)")
    return ", ".join(out)


def _chain(mode="add", clip=False, discount=0.8):
    def run(spark, sf_dir):
        found = sequence.chains(event_scores(spark, sf_dir), 3, GAP, discount, mode, clip)
        return found.select("task_idx", "video_id", "ts_ms", F.round("score", 6).alias("score"), joined("path").alias("path"))

    return run


_ROWS = " SELECT task_idx, video_id, ts_ms, round(score, 6) AS score, array_to_string(path, '|') AS path FROM chain"
for _name, _mode, _clip, _discount in (("sequence_dp", "add", False, 0.8), ("sequence_dp_prod", "prod", False, 0.8), ("clip_dp", "add", True, 0.9)):
    QUERIES[_name] = _chain(_mode, _clip, _discount)
    ORACLES[_name] = "WITH " + _sql_chain(SQL_EVENTS, GAP, _discount, _mode, _clip) + _ROWS

_EVENT_CHAIN = "WITH " + _sql_chain(SQL_EVENTS, GAP, 0.8)
_BEST = """, inside AS (SELECT c.task_idx, c.video_id, c.ts_ms, c.path, s.ts_ms AS at_ms, (s.a + s.b + s.c) / 3 AS mean FROM chain c JOIN scored s ON s.video_id = c.video_id AND s.ts_ms BETWEEN c.start_ms AND c.end_ms),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY mean DESC, at_ms) AS n FROM inside) WHERE n = 1)"""


def _moments(spark, sf_dir):
    scores = event_scores(spark, sf_dir)
    return sequence.with_best_moment(sequence.chains(scores, 3, GAP, 0.8), scores)


@query(_EVENT_CHAIN + _BEST + " SELECT video_id, ts_ms, path[1] AS start_ms, path[-1] AS end_ms, at_ms AS best_ms, round(mean, 6) AS best_score FROM best")
def sequence_best_frame(spark, sf_dir):
    return _moments(spark, sf_dir).select("video_id", "ts_ms", "start_ms", "end_ms", "best_ms", F.round("best_score", 6).alias("best_score"))


@query(_EVENT_CHAIN + _BEST + """ SELECT video_id, ts_ms, path[1] AS first_ms, path[2] AS second_ms, at_ms AS best_ms, path[2] AS median_ms, (path[1] + path[-1]) // 2 AS middle_ms, path[3] AS target_ms, path[2] AS negative_ms FROM best""")
def position_modes(spark, sf_dir):
    rows = _moments(spark, sf_dir)
    modes = [sequence.chosen_moment(m).alias(f"{m}_ms") for m in ("first", "second", "best", "median", "middle")]
    return rows.select("video_id", "ts_ms", *modes, sequence.chosen_moment("first", F.lit(2)).alias("target_ms"), sequence.chosen_moment("first", F.lit(-2)).alias("negative_ms"))


@query(_EVENT_CHAIN + """, m AS (SELECT video_id, ts_ms, (start_ms + end_ms) // 2 AS moment_ms FROM chain),
n AS (SELECT m.*, s.ts_ms AS at_ms, row_number() OVER (PARTITION BY m.video_id, m.ts_ms ORDER BY abs(s.ts_ms - moment_ms), s.ts_ms) AS k FROM m JOIN scored s USING (video_id))
SELECT video_id, ts_ms, moment_ms, at_ms AS frame_ms FROM n WHERE k = 1""".replace("JOIN scored s USING (video_id)", "JOIN scored s ON s.video_id = m.video_id"))
def snap_to_frame(spark, sf_dir):
    scores = event_scores(spark, sf_dir)
    found = sequence.chains(scores, 3, GAP, 0.8).select("video_id", "ts_ms", F.floor((F.element_at("path", 1) + F.element_at("path", -1)) / 2).cast("long").alias("moment_ms"))
    return sequence.snapped(found, scores)


_MOMENTS = "m AS (SELECT frame_id AS key, video_id, ts_ms AS frame_ms, ts_ms AS start_ms, least(ts_ms + 6000, 24000) AS end_ms FROM frames WHERE frame_id % 2 = 0 UNION ALL SELECT frame_id, video_id, ts_ms, greatest(ts_ms - 6000, 0), ts_ms FROM frames WHERE frame_id % 2 = 1)"


@query(f"""WITH {SQL_FRAMES}, {_MOMENTS},
s AS (SELECT m.key, f.ts_ms AS at_ms, abs(f.ts_ms - m.frame_ms) AS step, CASE WHEN f.ts_ms = m.frame_ms OR list_dot_product(o.emb, f.emb) / (sqrt(list_dot_product(o.emb, o.emb)) * sqrt(list_dot_product(f.emb, f.emb)) + 1e-6) >= 0.1 THEN 1 ELSE 0 END AS ok
  FROM m JOIN frames o ON o.video_id = m.video_id AND o.ts_ms = m.frame_ms JOIN frames f ON f.video_id = m.video_id AND f.ts_ms BETWEEN m.start_ms AND m.end_ms),
p AS (SELECT *, min(ok) OVER (PARTITION BY key ORDER BY step ROWS UNBOUNDED PRECEDING) AS good FROM s)
SELECT key, max_by(at_ms, step) AS slid_ms FROM p WHERE good = 1 GROUP BY key""")
def slide_refine(spark, sf_dir):
    f = frames(spark, sf_dir)
    even = f.filter("frame_id % 2 = 0").select(F.col("frame_id").alias("key"), "video_id", F.col("ts_ms").alias("frame_ms"), F.col("ts_ms").alias("start_ms"), F.least(F.col("ts_ms") + 6000, F.lit(24000)).alias("end_ms"))
    odd = f.filter("frame_id % 2 = 1").select(F.col("frame_id").alias("key"), "video_id", F.col("ts_ms").alias("frame_ms"), F.greatest(F.col("ts_ms") - 6000, F.lit(0)).alias("start_ms"), F.col("ts_ms").alias("end_ms"))
    return sequence.slid(even.withColumn("edge", F.lit(1)).unionByName(odd.withColumn("edge", F.lit(-1))), f, 0.1).select("key", "slid_ms")


def _sql_greedy(name: str, source: str, group: str, order: str, fields: str, cap: int | None = None, pad: int = 0, same: str = "") -> str:
    """A CTE of the rows that a greedy choice keeps, one list per group."""
    full = f"len(acc) >= {cap} OR " if cap else ""
    return f"""{name} AS (SELECT {group + ', ' if group else ''}unnest(list_reduce(list([{{{fields}}}] ORDER BY {order}), lambda acc, x: CASE WHEN {full}len(list_filter(acc, lambda k: {same}greatest(k.s, x[1].s) - {pad} <= least(k.e, x[1].e) + {pad})) > 0 THEN acc ELSE acc || x END)) AS k FROM {source} {'GROUP BY ' + group if group else ''})"""


_NMS = _sql_greedy("nms", "chain", "task_idx, video_id", "score DESC, ts_ms DESC", "'s': start_ms, 'e': end_ms, 'ts': ts_ms, 'score': score", 10)


def _survivors(spark, sf_dir):
    found = sequence.chains(event_scores(spark, sf_dir), 3, GAP, 0.8)
    return suppression.per_video(found.withColumns({"start_ms": F.element_at("path", 1), "end_ms": F.element_at("path", -1)}))


@query(_EVENT_CHAIN + ", " + _NMS + " SELECT task_idx, video_id, k.ts AS ts_ms, k.s AS start_ms, k.e AS end_ms, round(k.score, 6) AS score FROM nms")
def nms_per_video(spark, sf_dir):
    return _survivors(spark, sf_dir).select("task_idx", "video_id", "ts_ms", "start_ms", "end_ms", F.round("score", 6).alias("score"))


_PRED = """pred AS (SELECT (frame_id % 40)::INT AS task_idx, video_id, ts_ms AS frame_ms, ts_ms AS start_ms, ts_ms + 3000 AS end_ms, ((frame_id * 7919) % 100003) / 100003.0::DOUBLE AS sim FROM frames),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_idx ORDER BY sim DESC, video_id, frame_ms)::INT AS rank FROM pred)"""


def _predictions(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select((F.col("frame_id") % 40).cast("int").alias("task_idx"), "video_id", F.col("ts_ms").alias("frame_ms"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 3000).alias("end_ms"), (((F.col("frame_id") * 7919) % 100003) / 100003.0).alias("sim"))


_FMT = _sql_greedy("fmt", "pred", "task_idx, video_id", "sim DESC, frame_ms", "'s': start_ms, 'e': end_ms, 'f': frame_ms, 'sim': sim")


@query(f"WITH {SQL_FRAMES}, {_PRED}, {_FMT}, r AS (SELECT task_idx, video_id, k.f AS frame_ms, k.sim AS sim, row_number() OVER (PARTITION BY task_idx ORDER BY k.sim DESC, video_id, k.f)::INT AS rank FROM fmt) SELECT task_idx, video_id, frame_ms, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10")
def format_results(spark, sf_dir):
    return suppression.formatted(_predictions(spark, sf_dir), 10).select("task_idx", "video_id", "frame_ms", F.round("sim", 6).alias("sim"), "rank")


def _sql_exclusion(source: str, pad: int = PAD) -> str:
    greedy = _sql_greedy("excl", source, "video_id", "sim DESC, task_idx, rank", "'s': start_ms, 'e': end_ms, 't': task_idx, 'r': rank, 'f': frame_ms, 'sim': sim", None, pad)
    return greedy + ", final AS (SELECT k.t AS task_idx, video_id, k.f AS frame_ms, k.s AS start_ms, k.e AS end_ms, k.sim AS sim, row_number() OVER (PARTITION BY k.t ORDER BY k.sim DESC, k.r)::INT AS rank FROM excl)"


@query(f"WITH {SQL_FRAMES}, {_PRED}, best AS (SELECT * FROM ranked WHERE rank <= 10), {_sql_exclusion('best')} SELECT task_idx, video_id, frame_ms, round(sim, 6) AS sim, rank FROM final")
def global_exclusion(spark, sf_dir):
    best = suppression.ranked(_predictions(spark, sf_dir), 10)
    return suppression.exclusion(best, PAD, most=10).select("task_idx", "video_id", "frame_ms", F.round("sim", 6).alias("sim"), "rank")


@query(f"""WITH {SQL_FRAMES}, {_PRED}, best AS (SELECT * FROM ranked WHERE rank <= 12),
folded AS (SELECT unnest(list_reduce(list([{{'s': start_ms, 'e': end_ms, 't': task_idx, 'r': rank, 'f': frame_ms, 'v': video_id, 'sim': sim}}] ORDER BY sim DESC, task_idx, rank),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.t = x[1].t)) >= 5 OR len(list_filter(acc, lambda k: k.v = x[1].v AND greatest(k.s, x[1].s) - {PAD} <= least(k.e, x[1].e) + {PAD})) > 0 THEN acc ELSE acc || x END)) AS k FROM best)
SELECT k.t AS task_idx, k.v AS video_id, k.f AS frame_ms, round(k.sim, 6) AS sim, row_number() OVER (PARTITION BY k.t ORDER BY k.sim DESC, k.r)::INT AS rank FROM folded""")
def global_exclusion_capped(spark, sf_dir):
    best = suppression.ranked(_predictions(spark, sf_dir), 12)
    return suppression.exclusion(best, PAD, 5).select("task_idx", "video_id", "frame_ms", F.round("sim", 6).alias("sim"), "rank")


_E2E = RetrievalConfig(smoothing_window=0, max_gap_ms=6000, discount=0.8, position="second", overlap_ms=PAD, clip_to_zero=True)
_E2E_SCORED = f"""scored AS (SELECT q.task_idx, f.video_id, f.ts_ms, max(CASE WHEN q.sent_idx = 0 THEN 1 / (1 / (s.sim + 1 + 1e-6)) - 1 END) AS a, max(CASE WHEN q.sent_idx = 1 THEN 1 / (1 / (s.sim + 1 + 1e-6)) - 1 END) AS b,
  max(CASE WHEN q.sent_idx = 2 THEN 1 / (1 / (s.sim + 1 + 1e-6)) - 1 END) AS c FROM sims s JOIN queries q USING (query_id) JOIN frames f USING (frame_id) GROUP BY ALL)"""
_E2E_SQL = f"""WITH {SQL_FRAMES}, {sql_queries()}, {SQL_SIMS}, {_sql_chain(_E2E_SCORED, 6000, 0.8, 'add', True)}, {_sql_greedy('nms', 'chain', 'task_idx, video_id', 'score DESC, ts_ms DESC', "'s': start_ms, 'e': end_ms, 'm': path[2], 'score': score", 10)},
pred AS (SELECT task_idx, video_id, k.m AS frame_ms, k.s AS start_ms, k.e AS end_ms, k.score AS sim FROM nms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_idx ORDER BY sim DESC, video_id, frame_ms)::INT AS rank FROM pred), best AS (SELECT * FROM ranked WHERE rank <= 10), {_sql_exclusion('best')}
SELECT task_idx, video_id, frame_ms, start_ms, end_ms, rank, round(sim, 5) AS sim FROM final"""


@query(_E2E_SQL)
def retrieve_e2e(spark, sf_dir):
    """The flagship: scores, chains, suppression, moments, ranks and exclusion across tasks."""
    return retrieve(frames(spark, sf_dir), queries(spark, sf_dir), _E2E).withColumn("sim", F.round("sim", 5))


@query(f"""WITH {SQL_FRAMES}, {sql_queries()}, {SQL_SIMS},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, frame_id) AS n FROM sims) WHERE n <= 100),
dense AS (SELECT q.task_idx, q.sent_idx, f.frame_id, coalesce(t.sim, 0) AS sim FROM (SELECT DISTINCT q.task_idx, t.frame_id FROM top t JOIN queries q USING (query_id)) f JOIN queries q USING (task_idx) LEFT JOIN top t ON t.query_id = q.query_id AND t.frame_id = f.frame_id),
task AS (SELECT task_idx, frame_id, avg(1 / (1 / (sim + 1 + 1e-6)) - 1) AS sim FROM dense GROUP BY ALL),
b AS (SELECT t.task_idx, f.video_id, f.ts_ms AS frame_ms, t.sim, row_number() OVER (PARTITION BY t.task_idx, f.video_id ORDER BY t.sim DESC, frame_id) AS n FROM task t JOIN frames f USING (frame_id)),
pred AS (SELECT task_idx, video_id, frame_ms, frame_ms AS start_ms, frame_ms AS end_ms, sim FROM b WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_idx ORDER BY sim DESC, video_id, frame_ms)::INT AS rank FROM pred), best AS (SELECT * FROM ranked WHERE rank <= 10), {_sql_exclusion('best')}
SELECT task_idx, video_id, frame_ms, rank, round(sim, 5) AS sim FROM final""")
def retrieve_top_frames(spark, sf_dir):
    """Retrieval without sequences: top-k frames, dense zeros, mean over the scenes."""
    config = RetrievalConfig(smoothing_window=0, candidate_frames=100, overlap_ms=PAD)
    found = retrieve(frames(spark, sf_dir), queries(spark, sf_dir), config, sequential=False)
    return found.select("task_idx", "video_id", "frame_ms", "rank", F.round("sim", 5).alias("sim"))


@query(f"WITH {SQL_FRAMES} SELECT frame_id AS key, ts_ms AS slid_ms FROM frames WHERE frame_id % 5 = 0")
def slide_middle(spark, sf_dir):
    """A middle doesn't slide, even where it is the sequence's first frame in time."""
    f = frames(spark, sf_dir)
    path = F.array("ts_ms", F.col("ts_ms") + 1000)
    rows = f.filter("frame_id % 5 = 0").select(F.col("frame_id").alias("key"), "video_id", path.alias("path"), F.lit(None).cast("long").alias("best_ms"), F.col("ts_ms").alias("frame_ms"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 1000).alias("end_ms"))
    return sequence.slid(rows.withColumn("edge", sequence.chosen_edge("middle")).drop("path", "best_ms"), f, -1.0).select("key", "slid_ms")


@query(_EVENT_CHAIN + _BEST + """ SELECT video_id, ts_ms, 1 AS first_edge, CASE WHEN at_ms = path[1] THEN 1 WHEN list_position(path, at_ms) = 3 THEN -1 ELSE 0 END AS best_edge, 0 AS middle_edge, 0 AS median_edge, -1 AS target_edge, 0 AS negative_edge FROM best""")
def chosen_edges(spark, sf_dir):
    rows = _moments(spark, sf_dir)
    modes = [sequence.chosen_edge(m).alias(f"{m}_edge") for m in ("first", "best", "middle", "median")]
    return rows.select("video_id", "ts_ms", *modes, sequence.chosen_edge("first", F.lit(2)).alias("target_edge"), sequence.chosen_edge("first", F.lit(-2)).alias("negative_edge"))


# Tasks of one, two and three scenes; the last scenes of shorter ones are left out.
_MIXED_SCORED = _E2E_SCORED.replace("FROM sims s JOIN queries q USING (query_id)", "FROM sims s JOIN queries q ON q.query_id = s.query_id AND q.sent_idx <= q.task_idx % 3")
_MIXED_TARGET = "CASE WHEN task_idx % 4 = 0 THEN 0 WHEN task_idx % 4 = 1 THEN 1 END"
_MIXED_SQL = f"""WITH {SQL_FRAMES}, {sql_queries()}, {SQL_SIMS}, {_sql_chain(_MIXED_SCORED, 6000, 0.8, 'add', True)},
ends AS (SELECT task_idx, video_id, ts_ms, dp AS score, path FROM d1 WHERE dp IS NOT NULL AND task_idx % 3 = 1 UNION ALL SELECT task_idx, video_id, ts_ms, dp, path FROM d2 WHERE dp IS NOT NULL AND task_idx % 3 = 2),
spans AS (SELECT *, path[1] AS start_ms, path[-1] AS end_ms FROM ends), {_sql_greedy('nms', 'spans', 'task_idx, video_id', 'score DESC, ts_ms DESC', "'s': start_ms, 'e': end_ms, 'p': path, 'score': score", 10)},
single AS (SELECT task_idx, video_id, ts_ms, a AS sim, row_number() OVER (PARTITION BY task_idx, video_id ORDER BY a DESC, ts_ms) AS n FROM scored WHERE task_idx % 3 = 0),
pred AS (SELECT task_idx, video_id, CASE WHEN {_MIXED_TARGET} IS NOT NULL THEN k.p[{_MIXED_TARGET} + 1] ELSE k.p[2] END AS frame_ms, k.s AS start_ms, k.e AS end_ms, k.score AS sim FROM nms UNION ALL SELECT task_idx, video_id, ts_ms, ts_ms, ts_ms, sim FROM single WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_idx ORDER BY sim DESC, video_id, frame_ms)::INT AS rank FROM pred), best AS (SELECT * FROM ranked WHERE rank <= CASE WHEN task_idx % 5 = 0 THEN 3 ELSE 10 END), {_sql_exclusion('best')}
SELECT task_idx, video_id, frame_ms, start_ms, end_ms, rank, round(sim, 5) AS sim FROM final"""


@query(_MIXED_SQL)
def retrieve_mixed_scenes(spark, sf_dir):
    """Tasks with one to three scenes, a target scene for some, and their own number of predictions for others."""
    asked = queries(spark, sf_dir).filter(F.col("sent_idx") <= F.col("task_idx") % 3)
    target = F.when(F.col("task_idx") % 4 == 0, 0).when(F.col("task_idx") % 4 == 1, 1)
    tasks = asked.select("task_idx").distinct().select("task_idx", target.alias("target_scene"), F.when(F.col("task_idx") % 5 == 0, 3).alias("max_predictions"))
    config = RetrievalConfig(smoothing_window=0, max_gap_ms=6000, discount=0.8, position="second", overlap_ms=PAD, clip_to_zero=True, slide_threshold=2.0)
    return retrieve(frames(spark, sf_dir), asked, config, tasks=tasks).withColumn("sim", F.round("sim", 5))
