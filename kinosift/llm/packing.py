"""Operator 10: best-fit packing after Martello-Toth dominance reduction.

Token counts are integers up to the capacity, so the whole instance is a histogram with at most
``capacity`` entries, whatever the number of documents.  The histogram alone comes to the driver; there
whole counts are reduced and packed at once, which gives pattern multiplicities.  Pieces find their
place by their rank among the pieces of equal length; ranks are counted in salted groups so that a length
shared by a third of all pieces is spread over all tasks.
"""

from __future__ import annotations

import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinosift.llm.chunks import PartEncoder
from kinosift.llm.runtime import id_and_text, ship, slices, written
from kinosift.llm.tokenizers_io import library_tokenizer, rank_encoder, vocabulary

CAPACITY = 2048
SEPARATOR = 0
_WORKER: dict[str, tuple] = {}


def _encoder(digest: str, content: bytes):
    if digest not in _WORKER:
        tokenizer = library_tokenizer(content)
        plain = lambda text: array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        markers = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranked = rank_encoder(content)
        part = plain if ranked is None else lambda text: array.array("I", ranked(text)).tobytes()
        quick = PartEncoder(part, limit=1_000_000, marker=markers[0] if len(markers) == 1 else None)
        _WORKER.clear()
        _WORKER[digest] = (plain, quick if len(markers) <= 1 else lambda text: None)
    return _WORKER[digest]


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Encode every whole text, end it with the separator, and cut what is longer than the capacity.

    Returns doc_id, piece (from 0), start (ids of the document before the piece), length, and ids (binary:
    little-endian unsigned 32-bit).  All pieces but the first of a cut document are full.  A null
    text is empty and gives one piece that holds only the separator; a null doc_id stays null;
    repeated rows give repeated pieces; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    digest, content = vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(content)
    end = int(separator).to_bytes(4, "little")

    def run(batches):
        plain, quick = _encoder(digest, shared.value)
        for batch in slices(batches):
            out = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = quick(text)
                ids = (plain(text) if values is None else b"".join(values)) + end
                total = len(ids) // 4
                start = 0
                stop = total if total <= capacity else (total % capacity or capacity)
                piece = 0
                while start < total:
                    for column, value in zip(out, (doc, piece, start, stop - start, ids[4 * start : 4 * stop])):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def _take(counts: np.ndarray, sizes: tuple[int, ...], limit: int | None = None) -> int:
    """How many times the set can be fixed with what is there; the counts are lowered."""
    need: dict[int, int] = {}
    for size in sizes:
        need[size] = need.get(size, 0) + 1
    times = min(int(counts[size]) // n for size, n in need.items())
    times = times if limit is None else min(times, limit)
    for size, n in need.items():
        counts[size] -= n * times
    return times


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix the sets that some best packing is sure to hold; counts keeps the rest.

    For a size s let t be the largest other size that still fits beside it.  The set {s, t} dominates every
    other feasible set with s if each choice A of two or more further sizes has sum(A) <= t, as t can
    then be exchanged for A.  This holds when t fills the sequence, when no two further sizes fit, or
    when at most two fit and no pair has a sum in (t, capacity - s].  If nothing fits beside s, {s}
    dominates.  Fixing only removes sizes, so the test stays true while both sizes last: whole
    counts are fixed at once.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s] > 0:
                counts[s] -= 1
                rest = capacity - s
                there = np.flatnonzero(counts[: rest + 1])
                counts[s] += 1
                if not len(there):
                    fixed.append(((s,), int(counts[s])))
                    counts[s] = 0
                    changed = True
                    break
                t = int(there[-1])
                if t < rest:
                    counts[s] -= 1
                    smallest = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
                    counts[s] += 1
                    pairs_fit = len(smallest) > 1 and smallest[0] + smallest[1] <= rest
                    triples_fit = len(smallest) > 2 and smallest.sum() <= rest
                    if triples_fit or pairs_fit and _pair_between(there, counts, t, rest, s):
                        break
                if (times := _take(counts, (s, t))) == 0:
                    break
                fixed.append(((s, t), times))
                changed = True
    return fixed


def _pair_between(there: np.ndarray, counts: np.ndarray, low: int, high: int, used: int) -> bool:
    """Whether two of the sizes there, beside one used, have a sum in (low, high]."""
    for a in there:
        a = int(a)
        best = int(there[np.searchsorted(there, high - a, side="right") - 1]) if high >= a + there[0] else 0
        if best == a and counts[a] - (a == used) < 2:
            below = there[there < a]
            best = int(below[-1]) if len(below) else 0
        if best and a + best > low:
            return True
    return False


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing size over a histogram: equal sequences are split and filled as one."""
    groups: dict[int, list[list]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = min((r for r, found in groups.items() if r >= s and found), default=0)
            if not room:
                each = capacity // s
                for copies, times in ((each, left // each), (left % each, 1)):
                    if copies and times:
                        groups.setdefault(capacity - copies * s, []).append([(s,) * copies, times])
                break
            pattern, times = groups[room].pop()
            used = min(left, times)
            if times > used:
                groups[room].append([pattern, times - used])
            groups.setdefault(room - s, []).append([(*pattern, s), used])
            left -= used
    return [(pattern, times) for found in groups.values() for pattern, times in found]


def slots(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows size, first rank, ranks, first sequence, offset, by size and first rank; and the number of sequences."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    patterns = reduce_by_dominance(counts, capacity)
    patterns += best_fit(counts, capacity)
    rows, following, sequence = [], [0] * (capacity + 1), 0
    for sizes, times in patterns:
        offset = 0
        for size in sizes:
            rows.append((size, following[size], times, sequence, offset))
            following[size] += times
            offset += size
        sequence += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5), sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY, tie: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """Add sequence_id and offset to rows with a column length from 1 to the capacity.

    ``pieces`` is read more than once, so hand in a written table.  The rank of equal lengths goes by a
    salted hash of the tie columns and then by those columns; rows equal in all of them can be exchanged.
    """
    spark = pieces.sparkSession
    ship(spark)
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = slots(histogram, capacity)
    shared = spark.sparkContext.broadcast(table)
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*tie)))
    ranked = ranked.join(before.hint("shuffle_hash"), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    schema = f"{', '.join(f'`{n}` {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long"
    width, size_at, rank_at = len(pieces.columns), pieces.columns.index("length"), len(pieces.columns)
    bits = 44

    def place(batches):
        found = shared.value
        keys = (found[:, 0] << bits) + found[:, 1]
        for batch in batches:
            rank = np.asarray(batch.column(rank_at), dtype=np.int64)
            at = np.searchsorted(keys, (np.asarray(batch.column(size_at), dtype=np.int64) << bits) + rank, side="right") - 1
            columns = [batch.column(i) for i in range(width)] + [pa.array(found[at, 3] + rank - found[at, 1]), pa.array(found[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of all documents with their checksum and place; the ids themselves aren't carried along."""
    pieces = token_pieces(docs, vocabulary_path, capacity, separator).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(pieces, "pieces"), capacity, ("doc_id", "piece", "start", "ids_crc32"))
