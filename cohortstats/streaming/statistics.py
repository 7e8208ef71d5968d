"""Sufficient statistics of a stream: sums add up, so each micro-batch adds its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import Round


def windowed_summary(events: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean, deviation, min and max of a value by time window and key; works on a table and on a stream,
    where rows later than ``late`` are dropped by the watermark."""
    v = F.col(value).cast("double")
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return out.select(F.col("w.start").alias("start"), by, "n", "mean", "std", "lo", "hi")


class RunningRound:
    """Keeps a round's sums, minima and maxima over micro-batches; give ``add`` to foreachBatch.

    A batch that is replayed after a failure is recognised by its number and not added twice.
    """

    def __init__(self, columns: dict[str, Column]):
        self.columns, self.sums, self.lows, self.highs, self.n, self.last = columns, dict.fromkeys(columns, 0.0), {}, {}, 0, -1

    def add(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        r = Round().sum("n", F.lit(1))
        for name, c in self.columns.items():
            r.sum(f"s_{name}", c).min(f"l_{name}", c).max(f"h_{name}", c)
        got = r.run(batch)
        self.last = number
        if not got["n"][0]:
            return
        self.n += int(got["n"][0])
        for name in self.columns:
            self.sums[name] += got[f"s_{name}"][0]
            self.lows[name] = min(self.lows.get(name, float("inf")), got[f"l_{name}"][0])
            self.highs[name] = max(self.highs.get(name, float("-inf")), got[f"h_{name}"][0])
