"""Operator 5: exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted inside each partition; spilled
runs are Spark's external sort.  Equal texts then stand side by side and full comparisons of
neighbours find the groups.  The splitters cut on a bounded key (leading bytes, a hash of the
whole, the identifier), so what is sampled stays small for long texts, and a group that holds a third of
all rows is spread over many partitions.  Such a group ends at a partition's edge; at most a few groups
per partition do, and these alone are put together by one small aggregate.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.llm.runtime import id_and_text, ship, slices, written

#: Leading bytes of the normalised text that the splitters see.
KEY_BYTES = 48
_RUNS = "doc_id long, row long, keep_id long, group_size long, text_sha256 string, edge boolean"


def _normalised(batches):
    for batch in slices(batches):
        low = pc.cast(pc.ascii_lower(batch.column(1)), pa.binary())
        more = batch.columns[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), low, pc.binary_slice(low, 0, KEY_BYTES), *more], names=["doc_id", "norm", "head", "row"][: 3 + len(more)])


def _runs(keep_largest: bool, carried: bool = False):
    """Walk the sorted rows of one partition and close a group whenever a neighbour differs.

    A carried row id is the last column.
    """

    def run(batches):
        head = text = None  # of the open group
        ids: list = []
        numbers: list = []  # row ids beside ids
        first_head = None  # groups whose head equals the partition's first or last one may go on elsewhere
        held: list[tuple] = []  # closed groups with the head of the open one

        def closed(ids, numbers, text):
            known = [i for i in ids if i is not None]
            best = (max(known) if keep_largest else min(known)) if known else None
            return ids, numbers, best, hashlib.sha256(text).hexdigest()

        def rows(groups, edge):
            columns = ([], [], [], [], [], [])
            for ids, numbers, best, digest in groups:
                n = len(ids)
                for column, value in zip(columns, (ids, numbers, [best] * n, [n] * n, [digest] * n, [edge] * n)):
                    column.extend(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "row", "keep_id", "group_size", "text_sha256", "edge"])

        for batch in batches:
            ready = []
            for doc, norm, *key in zip(*(column.to_pylist() for column in batch.columns)):
                number = key.pop() if carried else None
                if text is not None and norm != text:
                    held.append(closed(ids, numbers, text))
                    ids, numbers = [], []
                if key != head and head is not None:
                    if head == first_head:
                        yield rows(held, True)
                    else:
                        ready += held
                    held = []
                head, text = key, norm
                first_head = key if first_head is None else first_head
                ids.append(doc)
                numbers.append(number)
            if ready:
                yield rows(ready, False)
        if text is not None:
            held.append(closed(ids, numbers, text))
            yield rows(held, True)

    return run


def duplicates(docs: DataFrame, keep_largest: bool = False, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and row if docs have a column of row ids.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty.  The row
    with the smallest doc_id of a group stays, or with the largest on request.  A null doc_id loses against
    any other and is kept only if its group has no other (keep_id is null then).  Rows that share
    the kept doc_id are all marked as kept: they can't be told apart by it (see kept_rows).  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = [] if row is None else ["row"]
    schema = ", ".join(["doc_id long, norm binary, head binary", *(f"{c} long" for c in more)])
    keyed = id_and_text(docs, row).mapInArrow(_normalised, schema).withColumn("_hash", F.xxhash64("norm"))
    # Row numbers spread a group of one doc_id, too.
    keyed = keyed.withColumn("_number", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, "head", "_hash", "doc_id", "_number").sortWithinPartitions("head", "_hash", "norm", "doc_id")
    runs = written(ordered.select("doc_id", "norm", "head", "_hash", *more).mapInArrow(_runs(keep_largest, row is not None), _RUNS), "content-runs")
    # At most two groups per partition are at an edge (but for equal 64-bit hashes), so this table is bounded by the partitions.
    best = F.max("keep_id") if keep_largest else F.min("keep_id")
    split = runs.filter("edge").groupBy("text_sha256").agg(best.alias("_keep"), F.count(F.lit(1)).alias("_size")).withColumn("edge", F.lit(True))
    whole = runs.join(F.broadcast(split), ["text_sha256", "edge"], "left")
    keep, size = F.coalesce("_keep", "keep_id"), F.coalesce("_size", "group_size")
    return whole.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", *more)


def kept_rows(docs: DataFrame, row: str) -> DataFrame:
    """row: the id of the one row of each group that stays, the smallest among those that share the kept doc_id."""
    return duplicates(docs, row=row).filter("kept").groupBy("text_sha256").agg(F.min("row").alias("row")).select("row")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
