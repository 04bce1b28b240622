"""Operator 1: byte-level BPE encoding and decoding by corpus-level merge replay.

Words don't influence each other, so the replay may run over any set of distinct words: here over those of an Arrow slice
that the worker hasn't met (or has forgotten: its dictionary is bounded).  An inverted index leads from each merge, by the
rank that its pair makes, to the places where that pair stands in any word; the ranks come off a heap in order, and
a merge touches only the two neighbours of each place.  Nothing is shuffled: a replay over the distinct words of the whole
corpus would have to bring its ids back to every occurrence of every word.
"""

from __future__ import annotations

import bisect
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.llm.chunks import Generations, clean, simple
from kinosift.llm.runtime import id_and_text, ship, slices
from kinosift.llm.tokenizers_io import PATTERN, ranks, vocabulary

_WORKER: dict[str, "Codec"] = {}
_BITS = 24
_WALL = (1 << _BITS) - 1


class MergeReplay:
    """Merges of a rank file, replayed over many words at once."""

    def __init__(self, vocabulary_ranks: dict[bytes, int]) -> None:
        self.ranks = vocabulary_ranks
        self.single = np.array([vocabulary_ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in vocabulary_ranks.items():
            for cut in range(1, len(token)):
                left, right = vocabulary_ranks.get(token[:cut]), vocabulary_ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << _BITS | right] = rank
        self.first = np.array([vocabulary_ranks.get(bytes(divmod(pair, 256)), -1) for pair in range(65536)], dtype=np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.  A word that is a token by itself is that token."""
        found: list[list[int]] = [[]] * len(words)
        spelled: list[int] = []  # words that need merges
        for at, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                found[at] = [whole]
            elif word:
                spelled.append(at)
        if not spelled:
            return found
        # The bytes of all these words with a wall before each and at the end.
        sizes = np.array([len(words[at]) for at in spelled])
        starts = np.cumsum(sizes + 1) - sizes
        raw = np.frombuffer(b"\0" + b"\0".join([words[at] for at in spelled]) + b"\0", dtype=np.uint8)
        tokens = self.single[raw]
        tokens[np.append(starts - 1, len(raw) - 1)] = _WALL
        merged = np.full(len(raw), -1, dtype=np.int64)
        inner = (tokens[:-1] != _WALL) & (tokens[1:] != _WALL)
        merged[:-1][inner] = self.first[(raw[:-1].astype(np.int64) << 8 | raw[1:])[inner]]
        places = np.flatnonzero(merged >= 0)
        places = places[np.argsort(merged[places], kind="stable")]
        ranks, begin = np.unique(merged[places], return_index=True)
        index = dict(zip(ranks.tolist(), (found.tolist() for found in np.split(places, begin[1:]))))  # merged rank -> places of the left symbol
        symbols = tokens.tolist()
        ends = (starts + sizes).tolist()
        self._replay(symbols, merged.tolist(), index, ends)
        for at, start, end in zip(spelled, starts.tolist(), ends):
            found[at] = [t for t in symbols[start:end] if t >= 0]
        return found

    def _replay(self, tokens: list[int], ranks: list[int], index: dict[int, list[int]], ends: list[int]) -> None:
        """Apply the merges in rank order.

        tokens: symbols, -1 where one was merged away; ranks: what each symbol makes with its right neighbour, -1 for nothing.
        """
        pair = self.pairs.get
        after = list(range(1, len(tokens) + 1))
        before = list(range(-1, len(tokens) - 1))
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            later, waiting = [], -1
            for place in places:
                if ranks[place] != rank:
                    continue  # a neighbour has changed since
                if place < waiting:
                    later.append(place)
                    continue
                right = after[place]
                tokens[place], tokens[right], ranks[right] = rank, -1, -1
                beyond = after[place] = after[right]
                before[beyond] = place
                left = before[place]
                merged = ranks[place] = pair(rank << _BITS | tokens[beyond], -1)
                if merged >= 0:
                    if merged in index:
                        index[merged].append(place)
                    else:
                        index[merged] = [place]
                        heapq.heappush(heap, merged)
                    if merged < rank:  # this word has an earlier merge to do first
                        waiting = ends[bisect.bisect_right(ends, place)]
                merged = ranks[left] = pair(tokens[left] << _BITS | rank, -1)
                if merged >= 0:
                    if merged in index:
                        index[merged].append(left)
                    else:
                        index[merged] = [left]
                        heapq.heappush(heap, merged)
                    if merged < rank:
                        waiting = ends[bisect.bisect_right(ends, place)]
            if later:
                held = index.get(rank)
                if held is None:
                    index[rank] = later
                    heapq.heappush(heap, rank)
                else:
                    held += later


class Codec:
    """Encoder and decoder of one vocabulary, with the words that a worker has met."""

    def __init__(self, content: bytes, pattern: str = PATTERN, limit: int = 1_000_000) -> None:
        own = ranks(content)
        self.replay, self.split = MergeReplay(own), regex.compile(pattern).findall
        self.known: Generations[bytes] = Generations(limit)  # parts, each with the space in front that its key leaves out
        self.words: Generations[bytes] = Generations(limit // 2)
        tokens = [b""] * (max(own.values()) + 1)
        for token, rank in own.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        cut = [self._cut(text) for text in texts]
        values: dict[str, bytes] = {}
        unseen: list[str] = []
        get, find = self.known.young.get, self.known.find
        for part in set().union(*(parts for _, parts in cut)):
            value = get(part) or find(part)
            if value is None:
                unseen.append(part)
            else:
                values[part] = value
        odd = {part for part in unseen if not clean(part)}
        if odd:  # their texts need the whole pattern
            unseen = [part for part in unseen if part not in odd]
            cut = [(self.split(text), ()) if not odd.isdisjoint(parts) else (head, parts) for text, (head, parts) in zip(texts, cut)]
        words_of = {part: self.split(part if part[0] == "\n" else " " + part) for part in unseen}
        ids = self._ids({w for found in words_of.values() for w in found}.union(*(head for head, _ in cut)))
        for part, found in words_of.items():
            value = values[part] = b"".join([ids[w] for w in found])
            if len(part) < 100:
                self.known.put(part, value)
        return [np.frombuffer(b"".join([*map(ids.__getitem__, head), *map(values.__getitem__, parts)]), dtype="<i4") for head, parts in cut]

    def _ids(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of words, by one replay over those that the worker hasn't met."""
        ids: dict[str, bytes] = {}
        fresh: list[str] = []
        for word in wanted:
            value = self.words.young.get(word) or self.words.find(word)
            if value is None:
                fresh.append(word)
            else:
                ids[word] = value
        for word, found in zip(fresh, self.replay.encode([w.encode() for w in fresh])):
            value = ids[word] = array("i", found).tobytes()
            if len(word) < 100:
                self.words.put(word, value)
        return ids

    def _cut(self, text: str) -> tuple[list[str], list[str] | tuple]:
        """Words at the start of a text, and the parts after them that the pattern treats alike wherever they stand.

        A part goes without the space in front of it.  Parts that aren't clean show only later.
        """
        if simple(text):
            first, *parts = text.replace("\n", " \n").split(" ")
            if not first or first.split() == [first]:
                return self.split(first), parts
        return self.split(text), ()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens."""
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of the tokens of each text, gathered for all texts at once."""
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        sizes = self.lengths[flat]
        ends = np.cumsum(sizes)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[flat] - (ends - sizes), sizes)
        whole = self.bytes[places].tobytes()
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [whole[start:end] for start, end in zip(edges, edges[1:])]


def _codec(digest: str, content: bytes, pattern: str) -> Codec:
    key = digest + pattern
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Codec(content, pattern)
    return _WORKER[key]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.array([], dtype=np.int32), pa.int32()))


def encoded(docs: DataFrame, vocabulary_path: str, pattern: str = PATTERN, decode: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int) and, on request, the bytes decoded from them.

    Null texts count as empty and have no ids; null doc_ids and repeated rows are kept; other columns
    are ignored.  Special strings are ordinary text.
    """
    spark = docs.sparkSession
    ship(spark)
    digest, content = vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(content)

    def run(batches):
        codec = _codec(digest, shared.value, pattern)
        for batch in slices(batches):
            ids = codec.encode(batch.column(1).to_pylist())
            columns, names = [batch.column(0), _lists(ids)], ["doc_id", "ids"]
            if decode:
                columns.append(pa.array(codec.decode_all(ids), pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decode)


def decoded(encodings: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and the bytes of a column ids; null ids decode to no bytes."""
    spark = encodings.sparkSession
    ship(spark)
    digest, content = vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(content)

    def run(batches):
        codec = _codec(digest, shared.value, PATTERN)
        for batch in batches:
            found = codec.decode_all([np.array(i or [], dtype=np.int64) for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    return encodings.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest(found: DataFrame) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
