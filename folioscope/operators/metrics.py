"""Counters and summaries of events by name and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SERIES = 1024


def snapshot(events: DataFrame, order: str = "seq", max_series: int | None = MAX_SERIES) -> DataFrame:
    """(kind, name, labels, value, count, sum, min, max) of each series.

    Wants kind (increment or observe), name, labels (an ordered key of sorted
    labels) and value.  Only the first ``max_series`` series by arrival are kept
    (a registry's bound); None keeps all.
    """
    n, v = F.count(F.lit(1)), F.col("value")
    observed = F.col("kind") == "observe"
    out = events.groupBy("kind", "name", "labels").agg(F.min(order).alias("_first"), F.sum(v).alias("sum"), n.alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
    if max_series is not None:
        out = out.orderBy("_first", "kind", "name", "labels").limit(max_series)
    only = lambda c: F.when(observed, F.col(c)).alias(c)
    return out.select("kind", "name", "labels", F.when(~observed, F.col("sum")).alias("value"), only("count"), only("sum"), only("min"), only("max"))
