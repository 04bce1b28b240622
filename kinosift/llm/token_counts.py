"""Operator 2: token counts through a digest cache.

The cache is a table in the shared folder: content digest, tokenizer digest, count.  Documents are joined to
it by both digests; one document of each digest that it lacks is encoded, and the new
counts are appended before they are joined.  The digest is that of the normalised content: where the tokenizer drops white space
and parts don't influence each other, runs of ASCII white space count as one space, as they can't change the count.  Texts are dealt by
digest and doc_id, so that a text with a third of all rows doesn't meet in one task; everything else that moves is a digest.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.llm.chunks import Generations
from kinosift.llm.runtime import id_and_text, ship, slices, written
from kinosift.llm.tokenizers_io import library_tokenizer, vocabulary

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
#: White space to Python, but not to the tokenizer's patterns.
_ODD = re.compile("[\x1c-\x1f]").search
_WORKER: dict[str, "Counter"] = {}


class Counter:
    """Tokens in a text by a tokenizer that drops white space between words: parts count by themselves."""

    def __init__(self, content: bytes, limit: int = 800_000) -> None:
        tokenizer = library_tokenizer(content)
        self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
        # Only where white space is dropped, and doesn't join parts, do parts add up.
        self.by_parts = self.count(" \n ") == 0 and self.count("a b") == self.count("a") + self.count("b") and self.count(" a") == self.count("a")
        self.known: Generations[int] = Generations(limit)

        # White space then changes nothing either, unless an added token has some of its own.
        self.collapses = self.by_parts and not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values())

    def __call__(self, text: str) -> int:
        if not self.by_parts or _ODD(text):
            return self.count(text)
        parts = text.split()
        counts = list(map(self.known.young.get, parts))
        if None in counts:
            for at, value in enumerate(counts):
                if value is None:
                    part = parts[at]
                    value = self.known.young.get(part)
                    value = self.known.find(part) if value is None else value
                    if value is None:
                        value = self.count(part)
                        if len(part) < 100:
                            self.known.put(part, value)
                    counts[at] = value
        return sum(counts)


def token_counts(docs: DataFrame, vocabulary_path: str, cache_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens; the cache at cache_path gains what it lacked.

    Null texts count as empty; null doc_ids and repeated rows are kept; other columns are ignored.  The cache
    may hold other tokenizers and repeated entries, from runs side by side: entries of one key are equal.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer, content = vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(content)
    normal = F.col("text")
    if Counter(content).collapses:
        tokenizer += "+spaces"  # counts of texts normalised so
        normal = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    texts = id_and_text(docs).withColumns({"content_digest": F.unhex(F.sha2(normal, 256)), "_doc": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    keys = written(texts.select("doc_id", "_doc", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    stored = lambda: spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer_digest") == tokenizer).select("content_digest", "n_tokens")
    one_each = keys.groupBy("content_digest").agg(F.min("_doc").alias("_doc"))
    misses = one_each.join(stored().select("content_digest"), "content_digest", "left_anti")
    # Rows equal in both are repeats; they meet in this join, and one of them is encoded.
    chosen = texts.join(misses.hint("shuffle_hash"), ["content_digest", "_doc"], "left_semi").dropDuplicates(["content_digest", "_doc"]).select("content_digest", "text")

    def run(batches):
        if tokenizer not in _WORKER:
            _WORKER.clear()
            _WORKER[tokenizer] = Counter(shared.value)
        count = _WORKER[tokenizer]
        for batch in slices(batches):
            found = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer] * len(found), pa.string()), pa.array(found, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    chosen.mapInArrow(run, CACHE).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    # Of a large cache only what these documents need is put together; written first, so that both sides of the last join are plain
    # exchanges and a hot digest can be split.
    needed = stored().join(one_each.select("content_digest"), "content_digest", "left_semi")
    counts = written(needed.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keys.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")
