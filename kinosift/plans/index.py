"""Building an index as one plan: encode frames, read what is in them, keep complete videos, set failures aside."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinosift.operators import encoders
from kinosift.operators.joins import complete_videos, transcript_text


@dataclass(frozen=True)
class IndexModels:
    """Names of registered models; None leaves a part out."""

    image: str | None = "hashed"
    ocr: str | None = "lines"
    objects: str | None = "words"
    caption: str | None = "first_line"
    speech: str | None = "lines"


def indexed(frames: DataFrame, models: IndexModels = IndexModels()) -> tuple[DataFrame, DataFrame]:
    """The index (video_id, frame_no, ts_ms and a column per model) of complete videos, and the failures (video_id, frame_no, error).

    frames: video_id, frame_no, ts_ms, image.  A frame on which a model fails is a failure, and its video isn't complete.  All models
    run in one pass over the frames, in Arrow batches.
    """
    parts = {kind: name for kind, name in (("image", models.image), ("ocr", models.ocr), ("objects", models.objects), ("caption", models.caption)) if name}
    read = frames.select("video_id", "frame_no", "ts_ms", *[encoders.attempted(kind, name)("image").alias(kind) for kind, name in parts.items()])
    error = F.coalesce(*[F.when(F.col(f"{kind}.error").isNotNull(), F.concat(F.lit(f"{kind}: "), f"{kind}.error")) for kind in parts], F.lit(None).cast("string"))
    flat = read.select("video_id", "frame_no", "ts_ms", *[F.col(f"{kind}.value").alias("emb" if kind == "image" else kind) for kind in parts], error.alias("error"))
    expected = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_frames"))
    whole = complete_videos(flat.filter("error is null").drop("error"), expected)
    return whole, flat.filter("error is not null").select("video_id", "frame_no", "error")


def spoken(recordings: DataFrame, models: IndexModels = IndexModels()) -> DataFrame:
    """video_id, seg_no, start, end, text of recordings (video_id, sound)."""
    heard = recordings.select("video_id", encoders.model("speech", models.speech)("sound").alias("all"))
    return heard.select("video_id", F.posexplode("all").alias("seg_no", "s")).select("video_id", "seg_no", "s.start", "s.end", "s.text")


def with_speech(index: DataFrame, segments: DataFrame) -> DataFrame:
    """An index with the column speech: what is said at each frame."""
    keyed = segments.withColumnRenamed("video_id", "video_key")
    said = transcript_text(index.select(F.col("video_id").alias("video_key"), "ts_ms").distinct(), keyed)
    return index.join(said.select(F.col("video_key").alias("video_id"), "ts_ms", F.col("text").alias("speech")), ["video_id", "ts_ms"], "left")
