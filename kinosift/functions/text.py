"""Segmenters and text parsing as column expressions, and the registry of pluggable ones."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The connectives at which descriptions are cut.
SCENE_CUT = r"[.!?;]|\b(?:then|while|after|before|followed by|the scene shifts to|the scene shifts|scene shifts|the scene cuts to|cuts to|next|later)\b"
OBJECT_CUT = r",|\b(?:and|with|and then)\b"
CLAUSE_CUT = r"\b(?:while|and then|before|after)\b"
# Fixed value: what an object is asked for with.
OBJECT_PROMPT = "A photo that has: "

_JAVA = "(?iuU)"


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _cut(text: Column, pattern: str, longer_than: int) -> Column:
    return F.filter(F.transform(F.split(text, _JAVA + pattern, -1), stripped), lambda s: F.length(s) > longer_than)


def _or_whole(parts: Column, text: Column) -> Column:
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def scene_segments(text: Column) -> Column:
    """Scenes of a description; the description itself if none is longer than three characters."""
    return _or_whole(_cut(text, SCENE_CUT, 3), text)


def object_segments(text: Column) -> Column:
    """Objects of a scene; the scene itself if none is longer than two characters."""
    return _or_whole(_cut(text, OBJECT_CUT, 2), text)


def clause_segments(text: Column) -> Column:
    """Clauses as the tagger-based segmenter falls back to without its model; any that aren't empty."""
    return _or_whole(_cut(text, CLAUSE_CUT, 0), text)


def quoted(text: Column) -> Column:
    """Lower-case contents of all double quotes."""
    return F.transform(F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)), F.lower)


def object_words(text: Column) -> Column:
    """Distinct lower-case words, sorted."""
    words = F.split(F.regexp_replace(F.lower(text), "[.!?,'\"]", " "), r"(?U)\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def parsed_response(response: Column, text: Column) -> DataFrame | Column:
    """Struct (scenes, target_scene_index) of a language model's answer.

    An object from the first to the last brace counts first; malformed ones fall back to the text at once.  Without
    braces an array of strings counts.
    """
    braces = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    shape = "scenes array<string>, target_scene_index int"
    found = F.from_json(F.when(braces != "", braces), shape)
    listed = F.from_json(F.when((braces == "") & (brackets != ""), brackets), "array<string>")
    trim = lambda a: F.filter(F.transform(a, stripped), lambda s: F.coalesce(F.length(s), F.lit(0)) > 0)
    scenes = F.coalesce(trim(found["scenes"]), trim(listed))
    scenes = F.when(F.coalesce(F.size(scenes), F.lit(0)) > 0, scenes).otherwise(F.array(text))
    return F.struct(scenes.alias("scenes"), found["target_scene_index"].alias("target_scene_index"))


def shot_name(path: Column) -> Column:
    """The video's name inside a path or file name, as collections write it; empty if there is none."""
    return F.regexp_extract(path, r"(v3c\d+_\d+)", 1)


def ranked_name(path: Column) -> Column:
    """The rank that a file name ends with, 999 without one."""
    return F.coalesce(F.regexp_extract(path, r"rank[_-]?(\d+)", 1).try_cast("int"), F.lit(999))


def sanitised(name: Column) -> Column:
    """A name that can be a folder."""
    return F.regexp_replace(F.coalesce(name, F.lit("none")), "/", "_")


def model_segmenter(split: Callable[[str], list[str]]):
    """An Arrow function from texts to segments around a Python model; failures and no segments give the text back."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return split(text) or [text]
            except Exception:
                return [text]

        return texts.map(one)

    return run


def whole_text(text: Column) -> Column:
    """What the segmenters around a model give where the model isn't there: the text itself."""
    return F.array(text)


#: Names of segmenters around models that are not part of the engine, and what stands in for each until it is registered.
SCENE_SEGMENTERS: dict[str, Callable[[Column], Column]] = {"regex": scene_segments, "bert_srl": clause_segments, "spacy": whole_text, "sat": whole_text, "scenegraph": whole_text}
OBJECT_SEGMENTERS: dict[str, Callable[[Column], Column] | None] = {"regex": object_segments, "spacy": whole_text, "sat": whole_text, "scenegraph": whole_text, "none": None, "": None}
#: Names of language models; these have no stand-in.
LANGUAGE_MODELS = ("qwen", "phi3", "qwen1.5", "qwen3b", "qwen7b", "qwen3-8b")


def register_segmenter(name: str, split: Callable[[str], list[str]], scenes: bool = True) -> None:
    """Make a Python model known by name."""
    (SCENE_SEGMENTERS if scenes else OBJECT_SEGMENTERS)[name.lower()] = model_segmenter(split)


def segmenters(scene: str | None = "regex", objects: str | None = "regex"):
    """The scene and the object segmenter by name, in any case; unknown names mean regex, `none` and an empty name mean no objects.

    An error for a language model that isn't registered.
    """
    scene, objects = (scene or "regex").lower(), "regex" if objects is None else objects.lower()
    for name, known in ((scene, SCENE_SEGMENTERS), (objects, OBJECT_SEGMENTERS)):
        if name in LANGUAGE_MODELS and name not in known:
            raise ValueError(f"register a segmenter for the language model {name}")
    return SCENE_SEGMENTERS.get(scene, scene_segments), OBJECT_SEGMENTERS.get(objects, object_segments)


def expanded_queries(tasks: DataFrame, sequential: bool = True, split_query: bool = True, scene: str = "regex", objects: str = "none") -> DataFrame:
    """task_idx, sent_idx, seg_idx, text: each scene first, then its objects in their prompt."""
    if not split_query:
        return tasks.select("task_idx", F.lit(0).alias("sent_idx"), F.lit(0).alias("seg_idx"), F.col("description").alias("text"))
    if not sequential:
        return tasks.select("task_idx", F.lit(0).alias("sent_idx"), F.lit(0).alias("seg_idx"), F.col("description").alias("text"))
    of_scene, of_object = segmenters(scene, objects)
    scenes = tasks.select("task_idx", F.posexplode(of_scene(F.col("description"))).alias("sent_idx", "scene"))
    if of_object is None:
        parts = F.array("scene")
    else:
        found = of_object(F.col("scene"))
        at = F.array_position(found, F.col("scene"))
        rest = F.when(at > 0, F.concat(F.slice(found, 1, F.greatest(at.cast("int") - 1, F.lit(0))), F.slice(found, at.cast("int") + 1, F.size(found)))).otherwise(found)
        parts = F.concat(F.array("scene"), rest)
    rows = scenes.select("task_idx", "sent_idx", F.posexplode(parts).alias("seg_idx", "part"))
    return rows.select("task_idx", "sent_idx", "seg_idx", F.when(F.col("seg_idx") > 0, F.concat(F.lit(OBJECT_PROMPT), "part")).otherwise(F.col("part")).alias("text"))
