"""Nearest row in time, in either direction, without pairing everything."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_day(probes: DataFrame, days: DataFrame, probe: str, day: str) -> DataFrame:
    """probes (distinct) with nearest: the closest day, the earlier one on a tie. Both are dates; a month is a partition, its neighbours' last and first days come from an aggregate."""
    marks = probes.select(F.col(probe).alias("at"), F.lit(True).alias("asked")).unionByName(days.select(F.col(day).alias("at"), F.lit(False).alias("asked"))).distinct()
    month = F.trunc("at", "month")
    known = F.when(~F.col("asked"), F.col("at"))
    ends = marks.groupBy(month.alias("month")).agg(F.min(known).alias("first"), F.max(known).alias("last"))
    over = Window.orderBy("month")  # one row a month: a few hundred rows for any input
    ends = ends.select("month", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    within = Window.partitionBy(month).orderBy("at")
    down = F.last(known, True).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    up = F.first(known, True).over(within.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = marks.withColumn("down", down).withColumn("up", up).filter("asked").withColumn("month", month).join(F.broadcast(ends), "month")
    low, high = F.coalesce("down", "before"), F.coalesce("up", "after")
    best = F.when(high.isNull() | (F.datediff("at", low) <= F.datediff(high, F.col("at"))), low).otherwise(high)
    return near.select(F.col("at").alias(probe), best.alias("nearest"))


def last_before(probes: DataFrame, facts: DataFrame, key: str, at: str, since: str, reach: int, columns: tuple[str, ...], rank: str) -> DataFrame:
    """probes with ``columns`` of the last fact of their key at or before their time, if it is ``reach`` seconds old at most; null where there is none.

    Times are timestamps; of facts at one time the one with the largest ``rank`` counts. Time is cut into slots of ``reach``
    seconds, and a fact also stands in the slot after its own, so that each slot is looked at by itself: no task holds more than a key's
    rows of a slot, and nothing is paired. Null keys meet nothing.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(reach * 1_000_000))
    held = F.struct(F.col(since).alias("__since"), *columns)
    told = facts.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(since).alias("__at"), F.lit(0).alias("__asks"), F.col(rank).cast("long").alias("__rank"), held.alias("__fact"), F.lit(None).cast(probes.schema).alias("__probe"), F.explode(F.array(slot(since), slot(since) + 1)).alias("__slot"))
    asks = probes.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__asks"), F.lit(0).cast("long").alias("__rank"), F.lit(None).cast(told.schema["__fact"].dataType).alias("__fact"), F.struct(*probes.columns).alias("__probe"), slot(at).alias("__slot"))
    by = Window.partitionBy("__key", "__slot").orderBy("__at", "__asks", "__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = told.unionByName(asks.filter("__key is not null")).withColumn("__last", F.last("__fact", True).over(by)).filter("__asks = 1")
    near = F.unix_micros("__at") - F.unix_micros("__last.__since") <= F.lit(reach * 1_000_000)
    met = rows.select("__probe.*", *(F.when(near, F.col(f"__last.{c}")).alias(c) for c in columns))
    alone = asks.filter("__key is null").select("__probe.*", *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in columns))
    return met.unionByName(alone)
