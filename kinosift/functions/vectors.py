"""Vector expressions over array columns; they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, guard: float = 1e-9) -> Column:
    """The vector over its length; vectors shorter than the guard are left alone."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > guard, x.cast("double") / length).otherwise(x.cast("double")))


def cosine(a: Column, b: Column, guard: float = 1e-6) -> Column:
    """Cosine with a guard added to the product of the lengths."""
    return dot(a, b) / (norm(a) * norm(b) + guard)


def smoothed(frames: DataFrame, window: int = 3, sigma: float = 1.0) -> DataFrame:
    """Gaussian mean of each frame's vector with its neighbours by position in the video, brought to length 1.

    Windows up to 1 change nothing, even windows are an error.  Weights of neighbours that don't exist are left out.
    """
    if window <= 1:
        return frames
    if window % 2 == 0:
        raise ValueError("the smoothing window has to be odd")
    order, terms = Window.partitionBy("video_id").orderBy("frame_no"), []
    for shift in range(-(window // 2), window // 2 + 1):
        near = F.col("emb") if shift == 0 else F.lag("emb", -shift).over(order)
        terms.append(F.struct(F.lit(math.exp(-(shift**2) / (2 * sigma**2))).alias("w"), near.alias("v")))
    held = frames.withColumn("_near", F.filter(F.array(*terms), lambda t: t["v"].isNotNull()))
    weight = F.aggregate("_near", F.lit(0.0), lambda s, t: s + t["w"])
    zero = F.transform("emb", lambda x: x.cast("double") * 0.0)
    total = F.aggregate("_near", zero, lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + t["w"] * b.cast("double")))
    held = held.withColumn("_sum", F.transform(F.zip_with(total, F.array_repeat(weight, F.size("emb")), lambda a, w: a / w), lambda x: x))
    held = held.withColumn("_length", norm(F.col("_sum")))
    return held.withColumn("emb", F.transform("_sum", lambda x: F.when(F.col("_length") > 1e-9, x / F.col("_length")).otherwise(x))).drop("_near", "_sum", "_length")
