"""Queries of segmenters and text parsing."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from kinosift.functions import text
from kinosift.operators import encoders, language_models
from kinosift.operators.joins import split_by_cache
from kinosift.plans.index import indexed, spoken
from kinosift.sources.sinks import segment_report as report
from kinosift.sources.standard import descriptions, joined, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


_TEXTS = "texts AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"


def _sql_cut(column: str, pattern: str, longer: int) -> str:
    cut = f"list_filter(list_transform(regexp_split_to_array({column}, '(?i){pattern}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > {longer})"
    return f"CASE WHEN len({cut}) > 0 THEN {cut} ELSE [{column}] END"


def _segments(function, pattern: str, longer: int):
    def run(spark, sf_dir):
        return descriptions(spark, sf_dir).select("id", joined(function(F.col("text"))).alias("segments"))

    return run, f"WITH {_TEXTS} SELECT id, array_to_string({_sql_cut('text', pattern, longer)}, '|') AS segments FROM texts"


QUERIES["scene_segments"], ORACLES["scene_segments"] = _segments(text.scene_segments, text.SCENE_CUT, 3)
QUERIES["object_segments"], ORACLES["object_segments"] = _segments(text.object_segments, text.OBJECT_CUT, 2)
QUERIES["clause_segments"], ORACLES["clause_segments"] = _segments(text.clause_segments, text.CLAUSE_CUT, 0)


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_idx"), F.col("text").alias("description"))


_EXPANDED = f"""scenes AS (SELECT item_id AS task_idx, unnest({_sql_cut('text', text.SCENE_CUT, 3)}) AS scene, generate_subscripts({_sql_cut('text', text.SCENE_CUT, 3)}, 1) - 1 AS sent_idx FROM benchmark),
found AS (SELECT *, {_sql_cut('scene', text.OBJECT_CUT, 2)} AS objects FROM scenes),
parts AS (SELECT task_idx, sent_idx, [scene] || CASE WHEN list_position(objects, scene) > 0 THEN objects[: list_position(objects, scene) - 1] || objects[list_position(objects, scene) + 1 :] ELSE objects END AS p FROM found),
rows_ AS (SELECT task_idx, sent_idx::INT AS sent_idx, (generate_subscripts(p, 1) - 1)::INT AS seg_idx, unnest(p) AS part FROM parts),
expanded AS (SELECT task_idx, sent_idx, seg_idx, CASE WHEN seg_idx > 0 THEN '{text.OBJECT_PROMPT}' || part ELSE part END AS text FROM rows_)"""


@query(f"WITH {_EXPANDED} SELECT * FROM expanded")
def query_expand(spark, sf_dir):
    return text.expanded_queries(_tasks(spark, sf_dir), objects="regex")


@query(f"WITH {_EXPANDED} SELECT task_idx, sent_idx, max(CASE WHEN seg_idx = 0 THEN text END) AS scene, coalesce(string_agg(CASE WHEN seg_idx > 0 THEN text END, '|' ORDER BY seg_idx), '') AS objects FROM expanded GROUP BY ALL")
def segment_report(spark, sf_dir):
    rows = report(text.expanded_queries(_tasks(spark, sf_dir), objects="regex"))
    return rows.select("task_idx", "sent_idx", "scene", joined("objects").alias("objects"))


@query("""WITH t AS (SELECT page_id, regexp_extract_all(html, '"([^"]*)"', 1) AS q FROM pages) SELECT page_id, array_to_string(list_transform(q, lambda x: lower(x)), '|') AS quotes FROM t""")
def ocr_quotes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", joined(text.quoted(F.col("html"))).alias("quotes"))


@query(f"""WITH {_TEXTS} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[.!?,''"]', ' ', 'g'), '\\s+'), lambda w: w <> ''))), '|') AS words FROM texts""")
def object_words(spark, sf_dir):
    return descriptions(spark, sf_dir).select("id", joined(text.object_words(F.col("text"))).alias("words"))


_MADE = """CASE item_id % 4 WHEN 0 THEN 'Sure: {"scenes": ["' || item_id || ' first ", " ", "second"], "target_scene_index": 1} ok' WHEN 1 THEN '["one", " two ' || item_id || '"]' WHEN 2 THEN '{broken ["x"]}' ELSE 'no idea' END"""


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN item_id || ' first|second' WHEN 1 THEN 'one|two ' || item_id ELSE text END AS scenes, CASE WHEN item_id % 4 = 0 THEN 1 END AS target FROM benchmark""")
def segmenter_response(spark, sf_dir):
    made = F.expr(_MADE.replace("'Sure: {", "'Sure: {"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.parsed_response(made, F.col("text")).alias("p"))
    return rows.select("item_id", joined("p.scenes").alias("scenes"), F.col("p.target_scene_index").alias("target"))


@query("SELECT doc_id, md5(text) AS text_hash, doc_id % 3 = 0 OR coalesce(c.hit, false) AS hit FROM documents LEFT JOIN (SELECT DISTINCT md5(text) AS h, true AS hit FROM documents WHERE doc_id % 3 = 0) c ON c.h = md5(text)")
def segment_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    return split_by_cache(docs, docs.filter("doc_id % 3 = 0").select("text_hash").distinct())


@query("SELECT page_id, replace(coalesce(regexp_extract(url, '//(.*)$', 1), 'none'), '/', '_') AS folder, regexp_extract(url, '([^/]+)$', 1) AS last, coalesce(try_cast(regexp_extract(url, '([0-9]+)$', 1) AS INT), 999) AS rank FROM pages")
def names_and_ranks(spark, sf_dir):
    url = F.col("url")
    rank = F.coalesce(F.regexp_extract(url, "([0-9]+)$", 1).try_cast("int"), F.lit(999))
    return table(spark, sf_dir, "pages").select("page_id", text.sanitised(F.regexp_extract(url, "//(.*)$", 1)).alias("folder"), F.regexp_extract(url, "([^/]+)$", 1).alias("last"), rank.alias("rank"))


@query("SELECT event_id, lower(event_type) AS caption, array_to_string(list_transform(['A', event_type], lambda x: lower(x)), '|') AS objects FROM events")
def metadata_lowered(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.lower("event_type").alias("caption"), joined(F.transform(F.array(F.lit("A"), "event_type"), F.lower)).alias("objects"))


@query()
def encode_texts(spark, sf_dir):
    """Vectors of the built-in encoder."""
    return descriptions(spark, sf_dir).select("id", encoders.model("text", "hashed")("text").alias("vec"))


@query(f"WITH {_TEXTS} SELECT id, text AS sat, text AS scenegraph, text AS spacy FROM texts")
def absent_segmenters(spark, sf_dir):
    """Segmenters whose models aren't there give the text back."""
    columns = [joined(text.segmenters(name, "none")[0](F.col("text"))).alias(name) for name in ("sat", "scenegraph", "spacy")]
    return descriptions(spark, sf_dir).select("id", *columns)


@query("SELECT page_id, regexp_extract('/k/' || CASE WHEN page_id % 2 = 0 THEN 'v3c1_' || lpad(page_id::VARCHAR, 5, '0') ELSE 'other' END || '/rank_' || page_id || '.jpg', '(v3c[0-9]+_[0-9]+)', 1) AS video, CASE WHEN page_id % 3 = 0 THEN 999 ELSE page_id END AS rank FROM pages")
def frame_file_names(spark, sf_dir):
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("v3c1_"), F.lpad(F.col("page_id").cast("string"), 5, "0"))).otherwise("other")
    ranked = F.concat(F.lit("/k/rank_"), "page_id", F.lit(".jpg"))
    path = F.concat(F.lit("/k/"), name, F.lit("/rank_"), "page_id", F.lit(".jpg"))
    rank = text.ranked_name(F.when(F.col("page_id") % 3 == 0, "plain.jpg").otherwise(ranked)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", text.shot_name(path).alias("video"), rank.alias("rank"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')"


@query(f"""SELECT item_id, array_to_string({_LINES}, chr(10)) AS ocr, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), '|') AS objects, trim(string_split(text, chr(10))[1]) AS caption FROM benchmark""")
def index_parts(spark, sf_dir):
    """What the stand-in models read in passages taken as images, by the plan that builds an index."""
    rows = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).cast("string").alias("video_id"), (F.col("item_id") % 4).cast("int").alias("frame_no"), "item_id", F.col("text").alias("image"))
    whole, _ = indexed(rows.select("video_id", "frame_no", F.col("item_id").alias("ts_ms"), "image"))
    return whole.select(F.col("ts_ms").alias("item_id"), "ocr", joined("objects").alias("objects"), "caption")


@query(f"""WITH x AS (SELECT item_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM benchmark), w AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) * 0.5 AS s FROM x)
SELECT item_id, (i - 1)::INT AS seg_no, round(sum(s) OVER (PARTITION BY item_id ORDER BY i) - s, 3)::DOUBLE AS start, round(sum(s) OVER (PARTITION BY item_id ORDER BY i), 3)::DOUBLE AS "end", trim(line) AS text FROM w""")
def speech_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("video_id"), F.col("text").alias("sound"))
    return spoken(rows).select(F.col("video_id").alias("item_id"), "seg_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query("SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '[.] '), lambda x: trim(x) <> ''), '|') AS scenes FROM benchmark")
def model_segments(spark, sf_dir):
    """A stand-in for a language model that cuts at full stops, asked through the cache."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    known = rows.filter("item_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"), F.expr("transform(filter(split(text, '[.] '), x -> trim(x) <> ''), x -> x)").alias("segments")).dropDuplicates(["text_hash"])
    found, _ = language_models.segmented(rows, known, _stand_in, prompt="{text}")
    return found.select("item_id", joined("segments").alias("scenes"))


def _stand_in():
    return lambda prompts, temperature: [json.dumps([x for x in re.split("[.] ", p) if x.strip()]) for p in prompts]
