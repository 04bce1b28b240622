"""Counts that a job reports while it runs, without a pass of their own."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(rows: DataFrame, **more: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has n and further aggregates once an action over them is done."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), *[column.alias(name) for name, column in more.items()]), seen


def score_watch(sims: DataFrame) -> tuple[DataFrame, Observation]:
    """Similarities as they are, with their extremes and mean on the side."""
    return counted(sims, least=F.min("sim"), most=F.max("sim"), mean=F.avg("sim"))


class Progress:
    """Rows a second and the seconds left, from counts that come in."""

    def __init__(self, total: int, clock=time.monotonic) -> None:
        self.total, self.clock, self.done, self.began = total, clock, 0, clock()

    def add(self, n: int) -> dict[str, float | None]:
        self.done += n
        taken = self.clock() - self.began
        rate = self.done / taken if taken > 0 else None
        return {"done": self.done, "rate": rate, "left_s": (self.total - self.done) / rate if rate else None}
