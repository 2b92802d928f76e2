"""When the portal's jobs are due, and which of their firings no run answered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trigger:
    """A job's minutes of the hour, every hour or at ``hour`` (UTC) alone."""

    name: str
    minutes: tuple[int, ...]
    hour: int | None = None

    def times(self) -> list[int]:
        """Minutes of the day, in order."""
        return sorted(60 * h + m for h in (range(24) if self.hour is None else [self.hour]) for m in self.minutes)


# The portal's jobs.
TRIGGERS = (Trigger("ingest", (0, 15, 30, 45)), Trigger("adapt", (5, 20, 35, 50)), Trigger("calendar", (0,), 7))


def due_before(ts: Column, trigger: Trigger) -> Column:
    """The trigger's last firing at or before a time (timestamps without zone)."""
    times = F.array(*map(F.lit, trigger.times()))
    midnight = F.date_trunc("day", ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    before = F.array_max(F.filter(times, lambda t: t <= minute))
    last = F.timestamp_add("minute", F.lit(trigger.times()[-1] - 1440), midnight)
    return F.when(before.isNull(), last).otherwise(F.timestamp_add("minute", before, midnight))


def firings(days: DataFrame, triggers: tuple[Trigger, ...] = TRIGGERS, day: str = "day") -> DataFrame:
    """(trigger, due) of every firing on the days (timestamps at midnight, distinct)."""
    parts = [days.select(F.lit(t.name).alias("trigger"), F.explode(F.transform(F.array(*map(F.lit, t.times())), lambda m: F.timestamp_add("minute", m, F.col(day)))).alias("due")) for t in triggers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def answered(runs: DataFrame, days: DataFrame, name: str, ts: str, triggers: tuple[Trigger, ...] = TRIGGERS) -> DataFrame:
    """(trigger, due, runs): every firing on the days with its runs until the next one; runs belong to the last firing before them, so that nothing is paired by time. Runs of other names don't count."""
    of = F.coalesce(*(F.when(F.col(name) == t.name, due_before(F.col(ts), t)) for t in triggers))
    counts = runs.select(F.col(name).alias("trigger"), of.alias("due")).filter("due is not null").groupBy("trigger", "due").agg(F.count(F.lit(1)).alias("runs"))
    return firings(days, triggers).join(counts, ["trigger", "due"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
