"""Range, nearest, alignment and resume joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of two models' frames; the run fails if either has a frame that the other lacks.

    The check is part of the plan, so the join runs once, with the query that reads it.
    """
    whole = left.join(right, keys, "full_outer")
    missing = F.col("left_row").isNull() | F.col("right_row").isNull()
    checked = F.when(missing, F.raise_error(F.lit("the models' frames don't align"))).otherwise(F.col("left_row"))
    return whole.withColumn("left_row", checked.cast(whole.schema["left_row"].dataType))


def transcript_text(frames: DataFrame, segments: DataFrame, bucket_s: int = 60) -> DataFrame:
    """The first segment, by seg_no, that holds each frame's second, ends included; an empty text if none does.

    frames: video_key, ts_ms; segments: video_key, seg_no, start, end, text.  Segments are filed under every bucket of
    seconds that they touch, so the range join is an equi-join on video and bucket.
    """
    bucket = lambda c: F.floor(c / bucket_s).cast("long")
    filed = segments.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    at = frames.withColumn("t", F.col("ts_ms") / 1000.0).withColumn("bucket", bucket(F.col("t")))
    hit = at.alias("f").join(filed.alias("s"), (F.col("f.video_key") == F.col("s.video_key")) & (F.col("f.bucket") == F.col("s.bucket")) & F.col("t").between(F.col("start"), F.col("end")), "left")
    text = F.min_by("s.text", "s.seg_no")
    return hit.groupBy(F.col("f.video_key").alias("video_key"), "ts_ms").agg(F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("")).alias("text"))


def with_nearest(points: DataFrame, at: str, frames: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """points with near, a struct (ts_ms, frame_no): the frame of the video nearest to the time ``at``, the lower frame_no on ties.

    An as-of join: points and frames are put in one order per video and bucket of time, and each point takes the last frame before and
    the first after it; where its bucket has none, that of the nearest bucket that has some.  Nothing is paired, and a video with
    most of the points is dealt over its buckets.  near is null if the video has no frames.
    """
    frame = F.struct(F.col("ts_ms").cast("long").alias("ts_ms"), F.col("frame_no").cast("long").alias("frame_no"))
    rows = points.withColumn("_at", F.col(at).cast("long")).unionByName(frames.select("video_id", F.col("ts_ms").cast("long").alias("_at"), frame.alias("_frame")), allowMissingColumns=True)
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / bucket_ms).cast("long"))
    order = lambda sign: F.when(F.col("_frame").isNotNull(), F.struct(F.col("_frame.ts_ms"), sign * F.col("_frame.frame_no")))
    ends = rows.groupBy("video_id", "_bucket").agg(F.min_by("_frame", order(1)).alias("_first"), F.max_by("_frame", order(-1)).alias("_last"))
    beside = lambda column, by: F.last(column, ignorenulls=True).over(Window.partitionBy("video_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("video_id", "_bucket", beside("_last", F.col("_bucket")).alias("_earlier"), beside("_first", F.desc("_bucket")).alias("_later"))
    point, late = F.col("_frame").isNull(), F.desc("_frame.frame_no")
    side = lambda by: F.last("_frame", ignorenulls=True).over(Window.partitionBy("video_id", "_bucket").orderBy(by, point, late).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_before": side(F.col("_at")), "_after": side(F.desc("_at"))}).filter(point).join(ends, ["video_id", "_bucket"], "left")
    rows = rows.withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")})
    gap = F.col("_at") - F.col("_before.ts_ms"), F.col("_after.ts_ms") - F.col("_at")
    first = (gap[0] < gap[1]) | ((gap[0] == gap[1]) & (F.col("_before.frame_no") <= F.col("_after.frame_no")))
    near = F.when(F.col("_after").isNull() | first, F.col("_before")).otherwise(F.col("_after"))
    return rows.select(*points.columns, near.alias("near"))


def nearest(points: DataFrame, frames: DataFrame) -> DataFrame:
    """For each point (key, video_id, ms) the nearest frame, the first on ties; null if the video has none."""
    found = with_nearest(points.select("key", "video_id", "ms"), "ms", frames)
    return found.select("key", "video_id", "ms", F.col("near.frame_no").cast("int").alias("frame_no"), F.col("near.ts_ms").alias("ts_ms"))


def merged_metadata(sources: list[DataFrame], columns: list[str], keys: list[str]) -> DataFrame:
    """Outer join of sources; a later source's value goes over an earlier one's, null means it has none."""
    whole = sources[0]
    for later in sources[1:]:
        renamed = later.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
        whole = whole.join(renamed, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
    return whole


def unfinished(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return inputs.join(done.select(key), key, "left_anti")


def positioned(rows: DataFrame, order: list[str], ranges: int = 200) -> DataFrame:
    """rows with position: their place from 0 in the order of these columns.

    A bounded random sample gives splitters; rows count inside their range, and ranges by the few counts before them, so no
    task sees more than a range.  Name enough columns to tell rows apart: rows equal in all of them can be exchanged and stay in one range.
    """
    sample = rows.select(*order).orderBy(F.rand(17)).limit(10 * ranges).orderBy(*order).collect()
    key = F.struct(*order)
    cuts = sample[10::10]
    dealt = rows.withColumn("_range", F.lit(0))
    if cuts:
        fields = rows.select(*order).schema
        literal = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, fields)]) for cut in cuts])
        # How many splitters are not above the row, by halving: one compiled comparison a step.
        for step in (2**b for b in reversed(range(len(cuts).bit_length()))):
            dealt = dealt.withColumn("_range", F.col("_range") + F.when(F.get(literal, F.col("_range") + (step - 1)) <= key, step).otherwise(0))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_inside") - 1).cast("long").alias("position"))


def shard(position: Column, count: int, index: int) -> Column:
    """Membership of a row, by its place in the sorted list, in one of count shards."""
    return F.pmod(position, F.lit(count)) == index


def sharded(rows: DataFrame, order: list[str], count: int, index: int, limit: int | None = None) -> DataFrame:
    """The rows of one shard of the sorted list; a limit counts inside the shard."""
    mine = positioned(rows, order).filter(shard(F.col("position"), count, index))
    return (mine if limit is None else mine.filter(F.floor(F.col("position") / count) < limit)).drop("position")


def chunked(rows: DataFrame, order: list[str], chunks: int) -> DataFrame:
    """rows with chunk: the sorted list cut in as many runs of equal length, the last one shorter."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    size = F.ceil(F.col("_total") / chunks)
    return positioned(rows, order).crossJoin(F.broadcast(total)).withColumn("chunk", F.floor(F.col("position") / size).cast("long")).drop("_total", "position")


def metadata_at(rows: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """What metadata says of the frame at each row's video_id and ts_ms; null where it has no such frame."""
    held = metadata.select("video_id", "ts_ms", *columns)
    return rows.join(held, ["video_id", "ts_ms"], "left")


def described(rows: DataFrame, tasks: DataFrame, known_only: bool = False) -> DataFrame:
    """rows with the description of their task: empty where the task is unknown, or without such rows."""
    found = rows.join(tasks.select("task_id", "description"), "task_id", "inner" if known_only else "left")
    return found.withColumn("description", F.coalesce("description", F.lit("")))


def complete_videos(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of videos whose frames are all there; expected: video_id, n_frames."""
    counts = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("_done"))
    ready = counts.join(expected.select("video_id", "n_frames"), "video_id").filter(F.col("_done") == F.col("n_frames")).select("video_id")
    return rows.join(ready, "video_id", "left_semi")


def split_by_cache(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts with what the cache knows: hit says whether it does."""
    return texts.join(cache.withColumn("hit", F.lit(True)), "text_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
