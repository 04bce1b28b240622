"""Operator 8: removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are told apart by passes over ever longer keys, and only up to the threshold: suffixes that agree in all
passes share a window of threshold bytes.  A pass groups what the one before left together and lets singletons go.
The passes don't begin at a suffix's first byte, as sorting each suffix of the corpus would move it many times over; they begin
at the gram that the suffix's window is filed under, and grow from there:

* Pass 0, local: a window is filed under its minimiser, the smallest hashed gram inside it.  Equal windows have equal
  minimisers at equal places, so each run of windows under one minimiser is one entry, about one for thirty bytes.
* Pass 1, the gram: one that stands in one place only can't be in an equal window.
* Pass 2, the whole stretch that the entry's windows cover.  Equal stretches are equal windows throughout; all but the
  first are removed at once, and one of each goes on.
* Pass 3, cores: RUN windows that begin at neighbouring places have all bytes but RUN - 1 in common.  Of the stretches that
  differ under a shared gram only the runs whose common bytes stand in another stretch as well go on.
* Pass 4, the single windows of these runs.

Groups are never gathered: each pass is an aggregate (a count, or the first place) with partial sums, and its result
is joined back by the group's hash.  What decides are two independent 64-bit hashes together, in passes 2 and 4; the others only let
singletons go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.llm.runtime import discard, ship, slices, written

THRESHOLD = 100
GRAM = 40
#: Windows that share a core.
RUN = 16
#: Bytes that one round of array work holds; longer documents are walked in overlapping blocks.
BLOCK = 1 << 20
_U = np.uint64
_LAST_ID = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of all stretches of a byte array: sums of bytes times powers of an odd base, shifted to start at 0."""

    _powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, base: int) -> None:
        size = 1 << max(12, int(len(raw)).bit_length())
        if (base, size) not in self._powers:
            step, back = _U(base), _U(pow(base, -1, 1 << 64))
            self._powers[base, size] = tuple(np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, x, dtype=np.uint64)])) for x in (step, back))
        powers, self.back = self._powers[base, size]
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(1)) * powers[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[: len(self.sums)][start])


_BASE_A, _BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def entries(raw: np.ndarray, hashes: Hashes, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser place, first and last window of each entry, in order; the array counts as one document."""
    windows, span = len(raw) - threshold + 1, threshold - gram + 1
    if windows <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    grams = len(raw) - gram + 1
    # Sliding minimum over the grams of a window, leftmost on ties, by doubling.
    value, place, have = hashes(slice(0, grams), slice(gram, gram + grams)), np.arange(grams, dtype=np.int32), 1
    while have * 2 <= span:
        take = value[have:] < value[:-have]
        place = np.where(take, place[have:], place[:-have])
        value = np.where(take, value[have:], value[:-have])
        have *= 2
    take = value[span - have : span - have + windows] < value[:windows]
    chosen = np.where(take, place[span - have : span - have + windows], place[:windows])
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[first].astype(np.int64), first, np.concatenate([first[1:] - 1, [windows - 1]])


def _blocks(batch: pa.RecordBatch, threshold: int):
    """Byte arrays of at most BLOCK bytes and a margin, with the documents' rows and bounds in them and their shifts."""
    held, rows, bounds, size = [], [], [0], 0
    for row, text in enumerate(batch.column(2).to_pylist()):
        raw = text.encode()
        if len(raw) < threshold:
            continue
        for at in range(0, len(raw), BLOCK) if len(raw) > BLOCK else (0,):
            part = raw[at : at + BLOCK + threshold - 1] if len(raw) > BLOCK else raw
            if size and size + len(part) > BLOCK:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), rows, np.array(bounds)
                held, rows, bounds, size = [], [], [0], 0
            held.append(part)
            rows.append((row, at))
            size += len(part)
            bounds.append(size)
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), rows, np.array(bounds)


def _pack(first, last, at):
    """First window, number of further windows and lead of the gram as one number, ordered by the first window."""
    return first << 24 | (last - first) << 12 | (at - first)


def _unpack(span):
    first = span >> 24
    return first, first + (span >> 12 & 4095), first + (span & 4095)


def _scan(threshold: int, gram: int, whole: bool):
    """Entries of all documents: gram, and on request stretch, uid, tie, span."""

    def run(batches):
        for batch in slices(batches, 2, BLOCK):
            uids, ties = (np.asarray(batch.column(c)) for c in (0, 1))
            for raw, rows, bounds in _blocks(batch, threshold):
                hashes = Hashes(raw, _BASE_A)
                at, first, last = entries(raw, hashes, threshold, gram)
                # Windows that cross into the next document don't exist.
                own = np.searchsorted(bounds, at, side="right") - 1
                first = np.maximum(first, bounds[own])
                last = np.minimum(last, bounds[own + 1] - threshold)
                good = first <= last
                at, first, last, own = at[good], first[good], last[good], own[good]
                columns = [hashes(at, at + gram).view(np.int64)]
                if whole:
                    stretch = _mixed(Hashes(raw, _BASE_B)(first, last + threshold) + (at - first).astype(np.uint64) * _U(_BASE_A))
                    row, shift = (np.array([r[i] for r in rows], dtype=np.int64)[own] for i in (0, 1))
                    move = shift - bounds[own]
                    columns += [stretch.view(np.int64), uids[row], ties[row], _pack(first + move, last + move, at + move)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "stretch", "uid", "tie", "span"][: len(columns)])

    return run


def _stretches(threshold: int):
    """The bytes of the stretches listed for a document: uid, tie, span, bytes."""

    def run(batches):
        for batch in slices(batches, 2, BLOCK):
            uids, ties, spans, held = [], [], [], []
            for uid, tie, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for span in wanted:
                    first, last, _ = _unpack(span)
                    held.append(raw[first : last + threshold])
                uids += [uid] * len(wanted)
                ties += [tie] * len(wanted)
                spans += wanted
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ties, pa.int64()), pa.array(spans, pa.int64()), pa.array(held, pa.binary())], names=["uid", "tie", "span", "bytes"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The last column's bytes end to end, and where each begins."""
    column = batch.column(batch.num_columns - 1)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[starts[0] : starts[-1]], starts[:-1] - starts[0]


def _cores(threshold: int):
    """Cores of all stretches: core, sid, run.  Run k holds the windows that begin RUN * k to RUN * k + RUN - 1 bytes before the gram."""

    def run(batches):
        for batch in slices(batches, 2, BLOCK):
            raw, begin = _flat(batch)
            sids = np.asarray(batch.column(0))
            first, last, at = _unpack(np.asarray(batch.column(1)))
            low, high = (at - last) // RUN, (at - first) // RUN
            each = high - low + 1
            own = np.repeat(np.arange(len(sids)), each)
            k = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each) + low[own]
            start = (begin + at - first)[own] - RUN * k
            core = _mixed(Hashes(raw, _BASE_A)(start, start + threshold - RUN + 1) + k.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(sids[own]), pa.array(k.astype(np.int32))], names=["core", "sid", "run"])

    return run


def _windows(threshold: int):
    """Hashes of the windows in the listed runs of stretches: one, two, uid, tie, at."""

    def run(batches):
        for batch in slices(batches, 4, BLOCK):
            raw, begin = _flat(batch)
            uids, ties = (np.asarray(batch.column(c)) for c in (0, 1))
            first, last, at = _unpack(np.asarray(batch.column(2)))
            runs = batch.column(3)
            own = np.repeat(np.arange(len(uids)), np.diff(np.asarray(runs.offsets)))
            k = np.asarray(runs.flatten()).astype(np.int64)
            own, place = np.repeat(own, RUN), (np.repeat(at[own] - RUN * k, RUN).reshape(-1, RUN) - np.arange(RUN)).reshape(-1)
            good = (place >= first[own]) & (place <= last[own])
            own, place = own[good], place[good]
            start = begin[own] + place - first[own]
            pair = [Hashes(raw, base)(start, start + threshold).view(np.int64) for base in (_BASE_A, _BASE_B)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*pair, uids[own], ties[own], place.astype(np.int32))], names=["one", "two", "uid", "tie", "at"])

    return run


def _cut(batches):
    """Apply the marks: doc_id, n_bytes, spans, kept."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, 1):
        out = ([], [], [], [])
        for doc, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            raw, spans, kept, done = text.encode(), [], [], 0
            for start, end in sorted((m["start"], m["end"]) for m in marks or ()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            for start, end in spans:
                kept.append(raw[done:start])
                done = end
            kept.append(raw[done:])
            for column, value in zip(out, (doc, len(raw), [tuple(s) for s in spans], b"".join(kept))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), spans_type, pa.binary()))], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, the removed spans (bytes, end exclusive) and the bytes that are kept.

    A byte goes if a stretch of threshold bytes over it also starts earlier: in a smaller doc_id, or earlier in
    the same document.  Null texts count as empty.  A null doc_id comes after all others; different texts
    under one doc_id are documents in the order of a hash of their text; a repeated row is the same document and
    no earlier than itself.  Other columns are ignored.
    """
    if not RUN <= threshold - gram < 4096:
        raise ValueError("the threshold has to exceed the gram by 16 to 4095 bytes")
    spark = docs.sparkSession
    ship(spark)
    uid = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text")).withColumns({"uid": uid, "tie": F.xxhash64("text")})
    texts = base.select("uid", "tie", "text")
    # Aggregates are written before they are joined back: both sides are plain exchanges then, and a hot gram can be split.
    grams = texts.mapInArrow(_scan(threshold, gram, False), "gram long")
    twice = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "grams")
    found = texts.mapInArrow(_scan(threshold, gram, True), "gram long, stretch long, uid long, tie long, span long")
    alive = written(found.join(twice, "gram"), "suffixes")
    discard(twice)
    place = F.struct("uid", "tie", "span")
    firsts = written(alive.groupBy("gram", "stretch").agg(F.min(place).alias("least")), "stretches")
    ends = [F.shiftright("span", 24).cast("int").alias("start"), (F.shiftright("span", 24) + F.shiftright("span", 12).bitwiseAND(4095) + threshold).cast("int").alias("end")]
    marks = written(alive.join(firsts, ["gram", "stretch"]).filter(place > F.col("least")).select("uid", "tie", *ends), "equal-stretches")
    discard(alive)
    mixed = written(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "mixed-grams")
    same = ["uid", "tie"]
    single = firsts.join(mixed, "gram").select("least.*").groupBy(*same).agg(F.collect_list("span").alias("wanted"))
    held = texts.join(single.hint("shuffle_hash"), same).select("uid", "tie", "text", "wanted").dropDuplicates(same)
    held = held.mapInArrow(_stretches(threshold), "uid long, tie long, span long, bytes binary").withColumn("sid", F.monotonically_increasing_id())
    held = written(held, "different-stretches")
    discard(firsts, mixed)
    cores = written(held.select("sid", "span", "bytes").mapInArrow(_cores(threshold), "core long, sid long, run int"), "cores")
    again = written(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "repeated-cores")
    runs = written(cores.join(again, "core").groupBy("sid").agg(F.collect_list("run").alias("runs")), "runs")
    discard(cores, again)
    wanted = held.join(runs, "sid").select("uid", "tie", "span", "runs", "bytes")
    windows = written(wanted.mapInArrow(_windows(threshold), "one long, two long, uid long, tie long, at int"), "windows")
    discard(held, runs)
    least = windows.groupBy("one", "two").agg(F.min(F.struct("uid", "tie", "at")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two", "least")
    least = written(least, "first-windows")
    more = windows.join(least, ["one", "two"]).filter(F.struct("uid", "tie", "at") > F.col("least"))
    more = written(more.select("uid", "tie", F.col("at").alias("start"), (F.col("at") + threshold).alias("end")), "equal-windows")
    discard(windows, least)
    separate, marks = [marks, more], marks.unionByName(more)
    marks = written(marks.groupBy(*same).agg(F.collect_set(F.struct("start", "end")).alias("marks")), "marks")
    discard(*separate)
    whole = base.join(marks.hint("shuffle_hash"), same, "left").select("doc_id", "text", "marks")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the kept bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
