"""The log of streaming runs, written by a listener while they run: nothing is counted twice for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..sources.shared import exists

SCHEMA = "run_id string, query string, started_at string, batches long, rows_in long, rows_dropped long, seen map<string,long>, crashed boolean, error string"


class RunLog(StreamingQueryListener):
    """Appends a row to the table at ``path`` when a run ends: its batches, rows, rows that came too late and the sums of its observed counts (name.metric)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.open = spark, path, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.open[str(event.runId)] = {"query": event.name, "started_at": event.timestamp, "batches": 0, "rows_in": 0, "rows_dropped": 0, "seen": {}}

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p, run = event.progress, self.open.get(str(event.progress.runId))
        if run is None:
            return
        run["batches"] += bool(p.numInputRows)
        run["rows_in"] += p.numInputRows
        run["rows_dropped"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        for name, row in (p.observedMetrics or {}).items():
            for metric, value in row.asDict().items():
                if isinstance(value, int) and not isinstance(value, bool):
                    run["seen"][f"{name}.{metric}"] = run["seen"].get(f"{name}.{metric}", 0) + value

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        run = self.open.pop(str(event.runId), None)
        if run is not None:
            row = (str(event.runId), run["query"], run["started_at"], run["batches"], run["rows_in"], run["rows_dropped"], run["seen"], event.exception is not None, event.exception and event.exception[:500])
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def wait_for(log: RunLog, runs: int, seconds: float = 60) -> bool:
    """Whether so many runs are logged within the time; listeners are told after a run has ended."""
    import time

    end = time.time() + seconds
    while time.time() < end:
        if exists(log.spark, log.path) and log.rows().count() >= runs:
            return True
        time.sleep(0.2)
    return False
