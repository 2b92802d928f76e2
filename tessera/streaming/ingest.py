"""Micro-batches: each batch merges by key into a table directory; a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import first_rows
from ..sources.shared import exists

#: Folders of a merged table.
BUCKETS = 64


def merge_stream(stream: DataFrame, target_path: str, checkpoint: str, key: str, order: str, event_time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Appends rows with unknown keys to the Parquet table at target_path, all that is there by now (availableNow).

    The table is kept in BUCKETS folders by a hash of the key, and a batch reads the key column of its own
    keys' folders alone. A batch that runs again after a crash finds its rows in the table and adds none twice. With
    event_time, a key that comes again within ``delay`` of event time is dropped before it gets to the table, by state that
    the watermark bounds; what comes after that finds the key in the table. One query writes a table at a time: two that
    overlap could add the same key each, as plain Parquet has no transactions.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()  # read several times, but the state's work is done once
        if exists(spark, target_path):
            own = [r[0] for r in rows.select("__bucket").distinct().collect()]  # BUCKETS numbers at most
            held = spark.read.schema(rows.schema).parquet(target_path).filter(F.col("__bucket").isin(own)).select(key)
        else:
            held = spark.createDataFrame([], rows.select(key).schema)
        # A key's first row before anything else is moved: copies end here, and what is joined has each key once. A bucket's rows go to one task, which writes one file.
        first = first_rows(rows, key, order).join(held.select(F.col(key).alias("__held")), F.col(key).eqNullSafe(F.col("__held")), "left_anti")
        first.repartition("__bucket").write.partitionBy("__bucket").mode("append").parquet(target_path)
        rows.unpersist()

    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clamp_event_time(df: DataFrame, ts: str, now: object, ahead: str = "2 days") -> DataFrame:
    """Event times that are missing or too far ahead become now, before any watermark."""
    late = F.col(ts).isNull() | (F.col(ts) > F.lit(now) + F.expr(f"interval {ahead}"))
    return df.withColumn(ts, F.when(late, F.lit(now)).otherwise(F.col(ts)))
