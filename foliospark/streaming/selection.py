"""Selections as a stream: messages choose a value, the last valid one filters the graph. An extension of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_selections(messages: DataFrame, kind: str, allowed: list[str] | None = None) -> DataFrame:
    """(ts, value) of the messages (ts, type, value) of a kind; 'all' and values that aren't allowed mean null: no filter.

    Works on streams and tables alike.
    """
    v = F.when(F.col("value") == "all", None).otherwise(F.col("value"))
    v = F.when(v.isin(allowed), v) if allowed is not None else v.try_cast("int").cast("string")
    return messages.filter(F.col("type") == kind).select("ts", v.alias("value"))


def counts_by_window(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) per tumbling window; on a stream, events later than `late` are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")
