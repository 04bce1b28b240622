"""Pluggable models behind Arrow functions: encoders, recognisers, captioners, transcribers.

A model is made once per worker by its factory and kept.  Real models plug in by name; the one that comes along hashes
words, which is deterministic and needs no weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_FACTORIES: dict[tuple[str, str], Callable[[], Any]] = {}
_MODELS: dict[tuple[str, str], Any] = {}
KINDS = {"text": "array<float>", "image": "array<float>", "ocr": "string", "objects": "array<string>", "caption": "string", "speech": "array<struct<start:double,end:double,text:string>>"}


def register(kind: str, name: str, factory: Callable[[], Any]) -> None:
    """Make a model known: its factory returns a function from a list of inputs to a list of outputs."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}")
    _FACTORIES[kind, name] = factory


def _batched(batches: Iterator[pd.Series], size: int | None, call: Callable[[list], list]) -> Iterator[pd.Series]:
    """Answers in batches of one size whatever comes in, across videos and Arrow batches; the rest at the end."""
    held: list = []
    for batch in batches:
        held += batch.tolist()
        step = size or max(1, len(held))
        while len(held) >= step:
            yield pd.Series(call(held[:step]))
            held = held[step:]
    if held:
        yield pd.Series(call(held))


def model(kind: str, name: str, size: int | None = None):
    """An Arrow function that applies the model in batches, of a given size if it needs one; an error for a name that isn't registered."""
    if (kind, name) not in _FACTORIES:
        raise ValueError(f"unknown {kind} model: {name}")
    factory, key = _FACTORIES[kind, name], (kind, name)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODELS:
            _MODELS[key] = factory()
        yield from _batched(batches, size, _MODELS[key])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, KINDS[kind])


def hashed_words(size: int = 64) -> Callable[[list[str | None]], list[list[float]]]:
    """Signed hashed word counts of length 1; a text without words is all zeros."""

    def encode(texts: list[str | None]) -> list[list[float]]:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                code = zlib.crc32(word.encode())
                out[row, code % size] += 1 if code >> 31 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return list(np.divide(out, lengths, out=out, where=lengths > 0))

    return encode


register("text", "hashed", hashed_words)


def attempted(kind: str, name: str):
    """The same function with what went wrong: a struct (value, error).  A batch that fails is tried again one input at a time."""
    if (kind, name) not in _FACTORIES:
        raise ValueError(f"unknown {kind} model: {name}")
    factory, key = _FACTORIES[kind, name], (kind, name)

    def one(value):
        try:
            return _MODELS[key]([value])[0], None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _MODELS:
            _MODELS[key] = factory()
        for batch in batches:
            inputs = batch.tolist()
            try:
                found = [(value, None) for value in _MODELS[key](inputs)]
            except Exception:
                found = [one(value) for value in inputs]
            yield pd.DataFrame({"value": [f[0] for f in found], "error": [f[1] for f in found]}, index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, f"struct<value:{KINDS[kind]},error:string>")


# Stand-ins that read a text in place of an image or a recording, so that a whole index can be built and checked without weights.


def written_lines() -> Callable[[list[str | None]], list[str]]:
    """Recogniser of writing: the lines that aren't blank."""
    return lambda texts: ["\n".join(line for line in (t or "").split("\n") if line.strip()) for t in texts]


def written_line() -> Callable[[list[str | None]], list[str]]:
    """The same on one line."""
    return lambda texts: [" ".join(line for line in (t or "").split("\n") if line.strip()) for t in texts]


def seen_words(distinct: bool = False) -> Callable[[list[str | None]], list[list[str]]]:
    """Detector of objects: the words, as often as they stand there or once each, in order."""
    return lambda texts: [list(dict.fromkeys(words) if distinct else words) for words in ((t or "").split() for t in texts)]


def first_line() -> Callable[[list[str | None]], list[str]]:
    """Captioner: the first line."""
    return lambda texts: [(t or "").split("\n")[0].strip() for t in texts]


def spoken_lines(seconds: float = 0.5) -> Callable[[list[str | None]], list[list[dict]]]:
    """Transcriber: each line that isn't blank takes as many seconds a word, one after the other."""

    def run(texts):
        out = []
        for text in texts:
            at, found = 0.0, []
            for line in (text or "").split("\n"):
                if line.strip():
                    end = at + seconds * len(line.split())
                    found.append({"start": at, "end": end, "text": line.strip()})
                    at = end
            out.append(found)
        return out

    return run


register("ocr", "lines", written_lines)
register("ocr", "line", written_line)
register("objects", "words", seen_words)
register("objects", "distinct_words", lambda: seen_words(True))
register("caption", "first_line", first_line)
register("speech", "lines", spoken_lines)
register("image", "hashed", hashed_words)
