"""Operator 7: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The value of an n-gram in a text is the number of the text's distinct words that hold it, times the n-gram's log-count ratio.  All hashed n-grams are features; none are selected.  Training takes a sample of labelled documents
that is bounded by a parameter.  The executors count, per n-gram, the toxic and other documents that hold it (a table bounded by
the buckets) and send the sample's features; a ridge-penalised logistic regression over them is fitted on the driver.

The classifier is linear and its values add up over words, so that a worker keeps one number per word it has met.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.llm.chunks import Generations
from kinosift.llm.runtime import id_and_text, ship, slices, written

#: Labelled documents that training reads, chosen by a hash of doc_id (as expected; exact when there are fewer).
SAMPLE = 3_000
BUCKETS = 1 << 18
SIZES = (3, 4, 5)
SMOOTHING = 1.0
#: Chosen, with the form of the values, on a part of the training labels (see README).
RIDGE = 0.01
STEPS = 60
THRESHOLD = 0.7
_WORKER: dict = {}


def _grams(word: str) -> list[int]:
    """Distinct hashed n-grams of a word; one of tens of MB is walked once."""
    raw = f" {word} ".encode()
    return sorted({zlib.crc32(raw[i : i + n]) % BUCKETS for n in SIZES for i in range(len(raw) - n + 1)})


def words(text: str) -> set[str]:
    return set(text.lower().split())


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, and their values before the ratio."""
    found = np.array([g for w in words(text) for g in _grams(w)], dtype=np.int32)
    grams, counts = np.unique(found, return_counts=True)
    return grams, counts.astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, ratio included
    bias: float


class Scorer:
    """A model with the words that a worker has met."""

    def __init__(self, model: Model, limit: int = 400_000) -> None:
        self.model, self.known = model, Generations(limit)

    def of_word(self, word: str) -> float:
        value = self.known.find(word)
        if value is None:
            value = float(self.model.weight[_grams(word)].sum())
            if len(word) < 60:
                self.known.put(word, value)
        return value

    def __call__(self, text: str) -> float:
        own = words(text)
        values = list(map(self.known.young.get, own))
        if None in values:
            values = [self.of_word(w) if v is None else v for w, v in zip(own, values)]
        z = self.model.bias + sum(sorted(values))  # sorted: the same sum in any order of the set
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Loss:
    """Mean log-loss with its ridge over sparse rows, and its gradient; the last parameter is the bias."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ratio: np.ndarray) -> None:
        lengths = np.array([len(grams) for grams, _ in rows])
        self.labels, self.size = labels, len(ratio)
        self.column = np.concatenate([grams for grams, _ in rows]).astype(np.int32)
        self.value = np.concatenate([value for _, value in rows]).astype(np.float32) * ratio[self.column].astype(np.float32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)

    def __call__(self, at: np.ndarray) -> tuple[float, np.ndarray]:
        weight, n = at[:-1], len(self.labels)
        z = at[-1] + np.bincount(self.owner, weights=weight[self.column] * self.value, minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - self.labels
        slope = np.bincount(self.column, weights=error[self.owner] * self.value, minlength=self.size)
        loss = float(np.mean(np.logaddexp(0, z) - self.labels * z) + RIDGE / 2 / n * (weight @ weight))
        return loss, np.append((slope + RIDGE * weight) / n, error.mean())


def _fitted(loss: Loss, memory: int = 8) -> np.ndarray:
    """The least of a smooth convex loss by quasi-Newton steps with limited memory."""
    at = np.zeros(loss.size + 1)
    value, slope = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, shares = slope.copy(), []
        for move, change in reversed(moves):
            shares.append((move @ way) / (change @ move))
            way -= shares[-1] * change
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-12, float(np.linalg.norm(way)))
        for (move, change), share in zip(moves, reversed(shares)):
            way += move * (share - (change @ way) / (change @ move))
        step, down = 1.0, slope @ way
        while True:
            there = at - step * way
            next_value, next_slope = loss(there)
            if next_value <= value - 1e-4 * step * down or step < 1e-6:
                break
            step /= 2
        gain, pair = value - next_value, (there - at, next_slope - slope)
        if pair[0] @ pair[1] > 1e-12:
            moves = [*moves, pair][-memory:]
        at, value, slope = there, next_value, next_slope
        if gain < 1e-8:
            break
    return at


def ratios(zero: np.ndarray, one: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Log-count ratios of n-grams that zero and one documents of either kind hold."""
    return np.log(((one + SMOOTHING) / (n1 + 2 * SMOOTHING)) / ((zero + SMOOTHING) / (n0 + 2 * SMOOTHING)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    Null labels, null doc_ids and null texts teach nothing; a doc_id with several labels is toxic if one says so; repeated documents
    count as often as they come.  With labels of one kind, or none, every score is the share of toxic labels (one half if none).
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    known = known.filter(draw < F.lit(int((1 << 30) * min(1.0, sample / max(total, 1)))))
    # The sample of labels is bounded, so it is broadcast; the texts stay where they are.
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id"), "text").join(F.broadcast(known), "doc_id")
    texts = texts.select(F.col("toxic").alias("toxic"), F.col("text").cast("string").alias("text"))

    def gather(batches):
        for batch in slices(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["toxic", "grams", "counts"])

    rows = written(texts.mapInArrow(gather, "toxic int, grams array<int>, counts array<float>"), "toxicity-sample")

    def count(batches):
        held, kinds = np.zeros((2, BUCKETS), dtype=np.int64), [0, 0]
        for batch in batches:
            for label, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
                kinds[label] += 1
                held[label][grams.values.to_numpy()] += 1
        used = np.append(np.flatnonzero(held.sum(axis=0)), -1)
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(np.append(held[k][used[:-1]], kinds[k])) for k in (0, 1)]], names=["bucket", "zero", "one"])

    found = rows.select("toxic", "grams").mapInArrow(count, "bucket long, zero long, one long").groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toPandas()
    sizes = found[found["bucket"] == -1]
    n0, n1 = int(sizes["zero"].sum()), int(sizes["one"].sum())
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    found = found[found["bucket"] >= 0]
    zero, one = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zero[found["bucket"]], one[found["bucket"]] = found["zero"], found["one"]
    ratio = ratios(zero, one, n0, n1)
    held = rows.toArrow()
    grams, counts = ([x.values.to_numpy() for x in held.column(c)] for c in ("grams", "counts"))
    at = _fitted(Loss(list(zip(grams, counts)), held.column("toxic").to_numpy().astype(float), ratio))
    return Model(at[:-1] * ratio, float(at[-1]))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1) and predicted (1 from the threshold on).

    Null texts count as empty and get the score of no features; null doc_ids and repeated rows are kept;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, run_id = spark.sparkContext.broadcast(Model(model.weight.astype(np.float32), model.bias)), uuid.uuid4().hex

    def run(batches):
        if _WORKER.get("id") != run_id:
            _WORKER.update(id=run_id, score=Scorer(shared.value))
        score = _WORKER["score"]
        for batch in slices(batches):
            scores = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
