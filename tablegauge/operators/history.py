"""Summaries over the stored history of analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_summary(history: DataFrame, last: int = 5) -> DataFrame:
    """One row: datasets, counts per quality tier, mean score of the last five."""
    s = F.coalesce("score", F.lit(0))
    counts = history.agg(
        F.count("*").alias("datasets"), F.count_if(s >= 75).alias("good"),
        F.count_if((s >= 50) & (s < 75)).alias("needs_attention"), F.count_if(s < 50).alias("poor"),
    )
    recent = history_recent(history, last).agg(F.round(F.avg(s)).cast("long").alias("recent_avg_score"))
    return counts.crossJoin(F.broadcast(recent))


def history_recent(history: DataFrame, last: int | None = 3) -> DataFrame:
    """The newest entries first; ``None`` gives all of them."""
    ordered = history.orderBy(F.desc("analyzed_at"), F.desc("table_name"))
    return ordered if last is None else ordered.limit(last)
