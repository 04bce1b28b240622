"""Operator 3: language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, character n-grams score it, and a Viterbi pass with
a switching penalty labels the words of each document, all documents of a slice at once.  Training
gathers hashed n-gram counts by language, a table bounded by languages times buckets; the sample of labelled documents
is bounded by a parameter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinosift.llm.chunks import Generations
from kinosift.llm.runtime import id_and_text, ship, slices

UNKNOWN = "und"
#: Labelled documents per language that training reads, chosen by a hash of doc_id (as expected; exact when there are fewer).
SAMPLE_PER_LANGUAGE = 4000
BUCKETS = 1 << 16
#: Cost of changing the language between two words, and the most by which one word may speak against a language.
SWITCH = 8.0
FLOOR = 6.0
#: A language is a candidate for a script that makes up this share of its training letters.
LEAST_SCRIPT_SHARE = 0.01
SPANS = "array<struct<start:int,end:int,lang:string>>"
#: Longest word that is scored at once; longer runs of letters are cut, so that text without spaces takes no more memory.
LONGEST = 64
#: More labelled languages than this are an error, as their counts come to the driver.
MOST_LANGUAGES = 2000
#: Numbers that aren't decimal digits are word characters to Python, but no letters.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_RUNS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(rf"[^\W\d_{''.join(sorted(_NUMBERS))}]{{1,{LONGEST}}}")
#: First code point of each range of letters and its script.
_RANGES = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_STARTS = [start for start, _ in _RANGES]
_WORKER: dict = {}


def words_of(text: str) -> list[str]:
    """Runs of letters, cut where they are too long; what _WORDS finds, by a faster pattern where both find the same."""
    found = _RUNS.findall(text)
    if max(map(len, found), default=0) <= LONGEST and (text.isascii() or _NUMBERS.isdisjoint(text)):
        return found
    return _WORDS.findall(text)


def script(word: str) -> str:
    """The script of a word's first letter."""
    return _RANGES[max(0, bisect_right(_STARTS, ord(word[0])) - 1)][1]


def _grams(word: str) -> list[int]:
    raw = f" {word} ".encode()
    return [zlib.crc32(raw[i : i + n]) % BUCKETS for n in (2, 3, 4) for i in range(len(raw) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets, float32
    scripts: dict[str, np.ndarray]  # script -> candidates, bool

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods below the best candidate's, not under -FLOOR; words x languages."""
        grams = [_grams(w) for w in words]
        counts = np.array([len(g) for g in grams])
        flat = np.fromiter((b for g in grams for b in g), dtype=np.int64, count=int(counts.sum()))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        sums = np.add.reduceat(self.log_p[:, flat], starts, axis=1).T
        every = np.ones(len(self.languages), dtype=bool)
        allowed = np.array([self.scripts.get(script(w), every) for w in words])
        sums = np.where(allowed, sums, -np.inf)
        return np.maximum(sums - sums.max(axis=1, keepdims=True), -FLOOR).astype(np.float32)


def viterbi(lengths: np.ndarray, states: np.ndarray, scores: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each position.  states: the row of scores at each position, texts end to end."""
    total = int(lengths.sum())
    labels = np.zeros(total, dtype=np.int16)
    if not total:
        return labels
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    long = lengths[order]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    alive = np.searchsorted(-long, -np.arange(long[0]), side="left")  # texts longer than t
    at = np.concatenate([[0], np.cumsum(alive)])
    stays, bests = np.empty((total, scores.shape[1]), dtype=bool), np.empty(total, dtype=np.int16)
    value = scores[states[begin]].astype(np.float64)
    last = np.empty(len(long), dtype=np.int16)
    for t in range(1, int(long[0])):
        k = alive[t]
        if k < len(value):
            last[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        best = value.argmax(axis=1)
        floor = value.max(axis=1)[:, None] - switch
        stay = value >= floor
        stays[at[t] : at[t] + k], bests[at[t] : at[t] + k] = stay, best
        value = np.where(stay, value, floor) + scores[states[begin[:k] + t]]
    last[: len(value)] = value.argmax(axis=1)
    now = np.empty(len(long), dtype=np.int16)
    done = 0
    for t in range(int(long[0]) - 1, -1, -1):
        k = alive[t]
        now[done:k] = last[done:k]
        done = k
        labels[begin[:k] + t] = now[:k]
        if t:
            rows = at[t] + np.arange(k)
            now[:k] = np.where(stays[rows, now[:k]], now[:k], bests[rows])
    return labels


class Detector:
    """A model with the words that a worker has met."""

    def __init__(self, model: Model, limit: int = 400_000) -> None:
        self.model = model
        self.known: Generations[bytes] = Generations(limit)

    def labels(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text; of all texts end to end the labels, and whether the word says anything."""
        words = [words_of(t.lower()) for t in texts]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for found in words for w in found))}
        rows: list = [None] * len(distinct)
        fresh = []
        for word, i in distinct.items():
            value = self.known.young.get(word)
            rows[i] = self.known.find(word) if value is None else value
            if rows[i] is None:
                fresh.append(word)
        for some in (fresh[i : i + 20_000] for i in range(0, len(fresh), 20_000)):
            for word, scores in zip(some, self.model.score_words(some)):
                rows[distinct[word]] = scores.tobytes()
                if len(word) < 60:
                    self.known.put(word, rows[distinct[word]])
        scores = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, len(self.model.languages))
        lengths = np.array([len(found) for found in words], dtype=np.int64)
        states = np.fromiter((distinct[w] for found in words for w in found), dtype=np.int64, count=int(lengths.sum()))
        labels = viterbi(lengths, states, scores, SWITCH)
        tells = (scores.max(axis=1) > scores.min(axis=1))[states] if len(states) else np.zeros(0, dtype=bool)
        return words, labels, tells

    def __call__(self, texts: list[str], spans: bool) -> list[tuple]:
        """(language, share of letters, spans or None) of each text."""
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0, [] if spans else None) for _ in texts]
        words, labels, tells = self.labels(texts)
        out, at = [], 0
        for text, found in zip(texts, words):
            own, speak = labels[at : at + len(found)], tells[at : at + len(found)]
            at += len(found)
            if not found:
                out.append((UNKNOWN, 0.0, [] if spans else None))
                continue
            letters = np.bincount(own, weights=[len(w) for w in found], minlength=len(languages))
            best = int(letters.argmax())
            share = float(letters[best] / letters.sum()) if speak.any() else 1.0 / len(languages)
            out.append((languages[best], round(share, 6), self._spans(text, own) if spans else None))
        return out

    def _spans(self, text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
        spans: list[list] = []
        # Lower-casing can change the number of words only for letters with combining parts; those keep the last label.
        for i, match in enumerate(_WORDS.finditer(text)):
            lang = self.model.languages[labels[min(i, len(labels) - 1)]]
            if spans and spans[-1][2] == lang:
                spans[-1][1] = match.end()
            else:
                spans.append([match.start(), match.end(), lang])
        return [tuple(s) for s in spans]


def train(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from columns doc_id, text and lang; rows with a null lang or text teach nothing."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: int(r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labelled languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32), {})
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    bound: Column = F.lit(0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, sample / n))).otherwise(bound)
    chosen = rows.filter(draw < bound).select("lang", "text")

    def run(batches):
        counts = {lang: np.zeros(BUCKETS, dtype=np.int64) for lang in languages}
        scripts: dict[tuple[str, str], int] = {}
        for batch in slices(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
            for lang, held in words.items():
                grams = [_grams(w) for w in held]
                flat = np.fromiter((b for g in grams for b in g), dtype=np.int64, count=sum(map(len, grams)))
                counts[lang] += np.bincount(flat, weights=np.repeat(list(held.values()), [len(g) for g in grams]), minlength=BUCKETS).astype(np.int64)
                for word, n in held.items():
                    key = (lang, script(word))
                    scripts[key] = scripts.get(key, 0) + n * len(word)
        for lang, found in counts.items():
            used = np.flatnonzero(found)
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.nulls(n, pa.string()), pa.array(used, pa.int64()), pa.array(found[used], pa.int64())], names=["lang", "script", "bucket", "n"])
        if scripts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in scripts]), pa.array([k[1] for k in scripts]), pa.nulls(len(scripts), pa.int64()), pa.array(list(scripts.values()), pa.int64())], names=["lang", "script", "bucket", "n"])

    found = chosen.mapInArrow(run, "lang string, script string, bucket long, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    grams = found[found["script"].isna()]
    counts[grams["lang"].map(at).to_numpy(dtype=np.int64), grams["bucket"].to_numpy(dtype=np.int64)] = grams["n"]
    log_p = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    letters = found[~found["script"].isna()]
    whole = letters.groupby("lang")["n"].sum()
    scripts: dict[str, np.ndarray] = {}
    for row in letters.itertuples():
        if row.n >= LEAST_SCRIPT_SHARE * whole[row.lang]:
            scripts.setdefault(row.script, np.zeros(len(languages), dtype=bool))[at[row.lang]] = True
    return Model(languages, log_p, scripts)


def detected(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (share of letters) and, on request, labelled spans.

    Null texts and texts without letters are `und` with score 0, as is everything if nothing was learned;
    null doc_ids and repeated rows are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, run_id = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    kinds = [("lang_pred", pa.string()), ("score", pa.float64())] + [("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] * spans

    def run(batches):
        if _WORKER.get("id") != run_id:
            _WORKER.update(id=run_id, detector=Detector(shared.value))
        detect = _WORKER["detector"]
        for batch in slices(batches):
            found = detect(batch.column(1).to_pylist(), spans)
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(n for n, _ in kinds)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double" + f", spans {SPANS}" * spans)
