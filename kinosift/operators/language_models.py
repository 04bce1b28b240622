"""Segmenting texts with a language model: answers are asked for in batches and kept in a cache table.

The model is a function from a list of prompts and a temperature to a list of answers; it is made once per worker.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.operators.joins import split_by_cache

PROMPTS = {
    "scene": "Split this description of a video into its scenes, in order. Answer with a JSON object: scenes, a list of strings, and target_scene_index.\n\n{text}",
    "audio": "Give the words that are spoken in this description as a JSON list of strings, an empty one if nobody speaks.\n\n{text}",
    "object": "Give the things that this sentence is about as a JSON list of strings.\n\n{text}",
}
#: Temperatures of the attempts at one text.
ATTEMPTS = (0.3, 0.5, 0.7)
BATCH = 8
Generate = Callable[[list[str], float], list[str]]
_MODELS: dict[str, Generate] = {}


def parsed(answer: str) -> list[str] | None:
    """The scenes of an answer: those of an object from the first to the last brace, else a list; None if it can't be read."""
    for pattern, pick in ((r"\{.*\}", lambda x: x.get("scenes")), (r"\[.*\]", lambda x: x)):
        found = re.search(pattern, answer, re.DOTALL)
        if found:
            try:
                held = pick(json.loads(found[0]))
            except (ValueError, AttributeError):
                return None
            return [x.strip() for x in held if isinstance(x, str) and x.strip()] if isinstance(held, list) else None
    return None


def answers(generate: Generate, prompts: list[str], size: int = BATCH) -> list[str]:
    """Answers to all prompts in batches; a batch that fails is tried again in halves, and a prompt that fails alone has an empty answer."""
    out: list[str] = []
    while len(out) < len(prompts):
        batch = prompts[len(out) : len(out) + size]
        try:
            out += generate(batch, 0.0)
        except Exception:
            if size == 1:
                out.append("")
            size = max(1, size // 2)
    return out


def attempted(generate: Generate, prompt: str) -> list[str] | None:
    """One prompt at rising temperatures until an answer can be read; None if none can."""
    for temperature in ATTEMPTS:
        try:
            found = parsed(generate([prompt], temperature)[0])
        except Exception:
            found = None
        if found is not None:
            return found
    return None


def segmented(texts: DataFrame, cache: DataFrame, make: Callable[[], Generate], mode: str = "scene", prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """texts (with a column text) with segments, and the rows that the cache gains: text_hash, segments.

    The cache holds text_hash (sha256) and segments.  Only distinct texts that it lacks are asked for; a batch answer that can't be read
    is asked for once more by itself, and what can't be read at all gives the text back and isn't kept.
    """
    template, key = prompt or PROMPTS[mode], uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def ask(column: pd.Series) -> pd.Series:
        if key not in _MODELS:
            _MODELS[key] = make()
        prompts = [template.format(text=t) for t in column]
        found = [parsed(a) for a in answers(_MODELS[key], prompts)]
        return pd.Series([attempted(_MODELS[key], p) if f is None else f for p, f in zip(prompts, found)])

    held = split_by_cache(texts.withColumn("text_hash", F.sha2("text", 256)), cache.select("text_hash", F.col("segments").alias("_known")))
    misses = held.filter(~F.col("hit") & F.col("text").isNotNull()).select("text_hash", "text").distinct()
    fresh = misses.select("text_hash", ask("text").alias("segments"))
    gained = fresh.filter(F.col("segments").isNotNull())
    found = held.join(gained.withColumnRenamed("segments", "_fresh"), "text_hash", "left")
    return found.select(*texts.columns, F.coalesce("_known", "_fresh", F.array("text")).alias("segments")), gained
