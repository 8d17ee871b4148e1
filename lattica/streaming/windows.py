"""Streams of readings: sliding windows with watermarks, and moving averages that keep state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_sums(stream: DataFrame, at: str, by: list[str], value: str, size: str, slide: str, late: str) -> DataFrame:
    """Count and sum of each window and key; rows later than `late` are dropped."""
    w = F.window(at, size, slide).alias("w")
    out = stream.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def moving_average(stream: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """Exponential moving average of each key, carried over micro-batches: one number of state a key."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for v in rows[value]:
            last = float(v) if last is None else decay * last + (1 - decay) * float(v)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "ema": out})

    order_kind = stream.schema[order].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {order_kind}, ema double", "last double", "append", "NoTimeout")
