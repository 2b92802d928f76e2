"""Event-time windows over runs: failures by window, quiet spells, and how many rows came too late for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Names under which a stream's batches report what they saw.
SEEN = "seen"


def observed(stream: DataFrame, ts: str) -> DataFrame:
    """stream with its batches' number of rows and latest time observed on the way, at no pass of its own."""
    return stream.observe(SEEN, F.count(F.lit(1)).alias("rows"), F.max(ts).alias("latest"))


def failure_windows(stream: DataFrame, ts: str, failed: str, length: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(started, runs, failures) of each window of event time. A row is too late when its window ended before the watermark of the batch before: the latest time of the batches before that one, less ``delay``."""
    told = stream.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("failures"))
    return told.select(F.col("w.start").alias("started"), "runs", "failures")


def busy_spells(stream: DataFrame, source: str, ts: str, gap: str = "90 minutes", delay: str = "1 hour") -> DataFrame:
    """(source, started, stale_from, runs): spells of a source's runs of which none is ``gap`` or more after the one before; from stale_from until its next spell a source is stale. A spell is told once the watermark has passed stale_from."""
    told = stream.withWatermark(ts, delay).groupBy(source, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("runs"))
    return told.select(source, F.col("w.start").alias("started"), F.col("w.end").alias("stale_from"), "runs")


def rows_seen(query: StreamingQuery) -> int:
    """Rows that a finished query's batches observed."""
    return sum(p.observedMetrics[SEEN]["rows"] for p in query.recentProgress if SEEN in (p.observedMetrics or {}))
