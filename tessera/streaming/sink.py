"""Results of streams as tables: every batch has a folder of its own, which a repeated batch writes anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Each batch's rows under path/batch=<number>, all that is there by now (availableNow). A batch that runs again after a crash replaces its folder, so that no row stands twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches' rows with their number; without any, an empty table."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).option("ignoreMissingFiles", "true").parquet(f"{path}/")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of the last batch that has it."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
