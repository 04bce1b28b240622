"""Operator 6: near-duplicates by Order MinHash and banded alignment.

A document's five-word shingles are labelled by their occurrence, so that they are distinct.  Each sketch
function orders them by a hash of its own, takes several minima and hashes these in text order; equal sketches
make documents candidates.  Exact copies are one node from the start.  A pair is a link if the longest common
subsequence of the labelled shingles, inside a band, covers enough of both.  Nobody emits all pairs of a bucket:

* Leaders: every bucket names the member that stands in the largest buckets, which is the text that the others were
  copied from or close to it, and each member is compared with it.  That joins nearly all of a group of copies in one step.
* The rest: buckets that still hold several components (copies too far from the leader, documents that share a
  passage and nothing else) are split by their members' rarest shingles.  A link shares one of the rarest few of
  each side, and how few follows from both lengths, so this loses no link of a bucket; only pairs of different
  components meet, and frequent shingles never make a pair.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinosift.llm.runtime import discard, id_and_text, ship, slices, written

SHINGLE = 5
SIMILARITY = 0.8
#: Sketch functions and minima in each: at similarity 0.8 a pair shares no sketch with probability below 1e-4.
SKETCHES = 32
MINIMA = 6
#: Documents of few shingles get sketches of two minima as well, as six of few are drawn too rarely from the shared ones.
SHORT, SHORT_SKETCHES, SHORT_MINIMA = 90, 16, 2
#: Ratio of the classes of length that the rarest shingles are looked up by.
STEP = 1.03
_WORDS = re.compile(r"\w+")
_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(SHINGLE)], dtype=np.uint64)
_RANDOM = np.random.default_rng(20240229)
_ODD = _RANDOM.integers(0, 1 << 63, SKETCHES + SHORT_SKETCHES, dtype=np.uint64) * _U(2) + _U(1)
_MIX = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1 for k in range(MINIMA)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> tuple[np.ndarray, bytes]:
    """Hashes of the lower-case words, and a digest of their sequence."""
    words = _WORDS.findall(text.lower())
    return np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint32), hashlib.md5(" ".join(words).encode()).digest()


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles with their occurrence; all words make one shingle in shorter texts."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    wide = words.astype(np.uint64) + _U(1)
    count = max(1, n - SHINGLE + 1)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(min(SHINGLE, n)):
        total += wide[k : k + count] * _POWERS[k]
    total = _mixed(total)
    order = np.argsort(total, kind="stable")
    ordered = total[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not fresh.all():
        at = np.arange(count)
        label = np.empty(count, dtype=np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        total = np.where(label > 0, _mixed(total + label * _U(0x9E3779B97F4A7C15)), total)
    return total


def sketches(shingles: np.ndarray) -> np.ndarray:
    """Sketch values, int64; those of short documents follow the others."""
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.int64)

    def of(odd: np.ndarray, minima: int) -> np.ndarray:
        take = min(minima, n)
        keys = _mixed(shingles[None, :] * odd[:, None])
        least = np.argpartition(keys, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(odd), 1))
        least.sort(axis=1)  # text order
        return _mixed((shingles[least] * _MIX[None, :take]).sum(axis=1, dtype=np.uint64) + odd)

    found = of(_ODD[:SKETCHES], MINIMA)
    if n <= SHORT:
        found = np.concatenate([found, of(_ODD[SKETCHES:], SHORT_MINIMA)])
    return found.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared shingles in a banded alignment over all shingles of both; 0 if it can't reach ``least``.

    Labelled shingles are distinct, so the alignment is a longest increasing subsequence of positions.  A pair
    at the bound leaves at most band shingles unaligned, so that matches further off the diagonal can't be part of it.
    """
    if not len(a) or not len(b):
        return 0.0
    _, left, right = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    whole = len(a) + len(b)
    if len(left) < least * (whole - len(left)):
        return 0.0
    band = int(whole * (1 - 2 * least / (1 + least))) + 1
    order = np.argsort(left)
    left, right = left[order], right[order]
    right = right[np.abs(left - right) <= band]
    if len(right) and not (np.diff(right) > 0).all():
        tails: list[int] = []
        for j in right.tolist():
            at = bisect.bisect_left(tails, j)
            tails[at : at + 1] = [j]
        shared = len(tails)
    else:
        shared = len(right)
    return shared / (whole - shared)


def sketched(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A written table: rid (unique; the column row, if named), doc_id, digest, size (number of shingles), sketch, words."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            digests, sizes, marks, words = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes, digest = word_hashes(text)
                shingles = labelled_shingles(hashes)
                digests.append(digest)
                sizes.append(len(shingles))
                marks.append(sketches(shingles))
                words.append(hashes.view(np.int32))
            more = batch.columns[2:]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), *more]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "size", "sketch", "words", "rid"][: len(columns)])

    found = id_and_text(docs, row).mapInArrow(run, "doc_id long, digest binary, size int, sketch array<long>, words array<int>" + (", rid long" if row is not None else ""))
    return written(found if row is not None else found.withColumn("rid", F.monotonically_increasing_id()), "sketched")


def components(links: DataFrame) -> DataFrame:
    """node and comp (its smallest connected node) for all nodes of links (a, b); large-star and small-star steps.

    Minima are written before they are joined back, so that both sides are plain exchanges and a hot node can be split.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.filter("u > v").distinct(), "components")
        discard(last, least, large, low)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.withColumn("comp", F.col("node")))


def _links(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """A written table of the pairs (a, b) that are links; words: rid, words."""
    left = words.select(F.col("rid").alias("a"), F.col("words").alias("left"))
    right = words.select(F.col("rid").alias("b"), F.col("words").alias("right"))
    texts = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            hashes = [[labelled_shingles(w.values.to_numpy(zero_copy_only=False).view(np.uint32)) for w in batch.column(c)] for c in (2, 3)]
            linked = [similarity(x, y) >= SIMILARITY for x, y in zip(*hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return written(texts.mapInArrow(run, "a long, b long, linked boolean").filter("linked").select("a", "b"), "pairs")


def _alike(a: str, b: str):
    """Whether two numbers of shingles can make a link."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY - 1e-9


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept, and row if docs have a column of unique row ids.

    A class is a connected component of exact copies (equal words in lower case) and verified links; class_id is
    its smallest doc_id.  The row with that doc_id is kept, one of them if ids repeat; null doc_ids come
    last, and class_id is null if there is no other.  Null and empty texts are copies of each other.  Other
    columns are ignored.
    """
    table = sketched(docs, row)
    # Joins that move sketches or words are shuffled at every size, so that a small run shows what a large one does.
    # The node of exact copies; written, so that a digest with many rows can be split when it is joined back.
    nodes = written(table.groupBy("digest").agg(F.min("rid").alias("node")), "nodes")
    members = written(table.select("rid", "doc_id", "digest").join(nodes.hint("merge"), "digest").select("rid", "doc_id", "node"), "members")
    marks = table.select("rid", "size", "sketch").join(nodes.select(F.col("node").alias("rid")).hint("merge"), "rid", "left_semi")
    marks = marks.select(F.col("rid").alias("node"), "size", F.posexplode("sketch").alias("at", "mark")).select("node", "size", F.xxhash64("at", "mark").alias("bucket"))
    rows = _different(marks)
    discard(nodes)
    # Words move once, for candidates only.
    words = written(table.select("rid", "words").join(rows.select(F.col("node").alias("rid")).distinct().hint("merge"), "rid", "left_semi"), "words")
    links = _links(_led(rows), words)
    first = written(components(links), "first-components")
    more = _links(_split(rows, first, words), words)
    discard(rows, words)
    # Later links join components, so only these are put together once more.
    whole = members.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    roots = first.select(F.col("node").alias("a"), F.col("comp").alias("to_a")), first.select(F.col("node").alias("b"), F.col("comp").alias("to_b"))
    joined = more.join(roots[0], "a", "left").join(roots[1], "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    second = written(components(joined), "second-components").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    whole = written(whole.join(second, "comp", "left").select("rid", "doc_id", F.coalesce("to", "comp").alias("comp")), "whole")
    discard(table, members, links, first, more)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = written(whole.groupBy("comp").agg(F.min(least).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    return whole.join(classes, "comp").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"), *([] if row is None else [F.col("rid").alias("row")]))


def _different(marks: DataFrame) -> DataFrame:
    """A written table of the rows (node, size, bucket, n) of buckets with n > 1 members; of buckets that hold the same members one is enough."""
    members = marks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("sum"))
    chosen = written(members.filter("n > 1").groupBy("n", "low", "high", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "chosen")
    rows = written(marks.join(chosen, "bucket").select("node", "size", "bucket", "n"), "buckets")
    discard(chosen)
    return rows


def _led(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a bucket and its leader."""
    scored = rows.groupBy("node").agg(F.sum("n").alias("score"))
    lead = rows.join(scored, "node").groupBy("bucket").agg(F.max(F.struct("score", "node", "size")).alias("lead"))
    lead = written(lead.select("bucket", F.col("lead.node").alias("leader"), F.col("lead.size").alias("leader_size")), "leaders")
    pairs = rows.join(lead, "bucket").filter((F.col("node") != F.col("leader")) & _alike("size", "leader_size"))
    return pairs.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()


def _split(rows: DataFrame, comps: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a rare shingle, for the nodes of buckets that hold several components.

    A link of documents with n and m labelled shingles shares at least t = ceil(s / (1 + s) * (n + m)) of them for the similarity s.  In any
    one order of all shingles the first n - t + 1 of one and the first m - t + 1 of the other then meet; here rare ones come first, counted
    among these nodes.  A node is filed under its first shingles once for each class of lengths that a partner can have, with the
    number that this class allows.
    """
    labelled = written(rows.join(comps, "node", "left").select("node", "bucket", F.coalesce("comp", "node").alias("comp")), "labelled")
    mixed = written(labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket"), "mixed")
    nodes = written(labelled.join(mixed, "bucket").select("node", "comp").distinct(), "open")

    def run(batches):
        for batch in batches:
            found = [labelled_shingles(w.values.to_numpy(zero_copy_only=False).view(np.uint32)) for w in batch.column(1)]
            sizes = [len(f) for f in found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64))], names=["node", "size", "shingle"])

    held = words.join(nodes.select(F.col("node").alias("rid")).hint("merge"), "rid", "left_semi").select("rid", "words")
    shingles = written(held.mapInArrow(run, "node long, size int, shingle long"), "shingles")
    counts = written(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle-counts")
    order = Window.partitionBy("node").orderBy("n", "shingle")
    ranked = shingles.join(counts, "shingle").withColumn("at", F.row_number().over(order) - 1).filter("n > 1")
    width, share = math.log(STEP), SIMILARITY / (1 + SIMILARITY)
    own = F.floor(F.log("size") / width + 1e-9).cast("int")
    # The longest partner that still allows this place among the first ones: t <= size - at.
    longest = F.floor((F.col("size") - F.col("at")) / share - F.col("size") + 1e-6)
    reach = math.ceil(math.log(1 / SIMILARITY) / width)
    top = F.least(own + reach, F.floor(F.log(longest) / width + 1e-9).cast("int"))
    filed = ranked.withColumns({"own": own, "top": F.when(longest >= 1, top)}).filter(F.col("top") >= F.greatest(F.col("own") - reach, F.lit(0)))
    filed = filed.select("node", "size", "shingle", "own", F.explode(F.sequence(F.greatest(F.col("own") - reach, F.lit(0)), F.col("top"))).alias("other"))
    filed = filed.select("node", "size", "own", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("own") == F.col("other")).alias("same"))
    sized = written(nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "comp-sizes")
    filed = written(filed.join(nodes.join(sized, "comp"), "node"), "filed")
    # Every pair has a side outside its key's largest component.
    main = filed.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    main = written(main.filter("low < high").select("key", F.col("main.comp").alias("main")), "keys")
    inner = written(filed.join(main, "key").select("key", "node", "size", "own", "same", "comp", "main"), "inner")
    outer = inner.filter("comp <> main").select("key", F.col("node").alias("outer"), F.col("size").alias("outer_size"), F.col("own").alias("outer_own"), F.col("comp").alias("outer_comp"))
    meet = (F.col("comp") != F.col("outer_comp")) & (F.col("same") | (F.col("own") != F.col("outer_own"))) & _alike("size", "outer_size")
    pairs = written(inner.join(outer, "key").filter(meet).select(F.greatest("node", "outer").alias("a"), F.least("node", "outer").alias("b")).distinct(), "rare-pairs")
    discard(labelled, mixed, nodes, shingles, counts, sized, filed, main, inner)
    return pairs
