"""One article's way from draft to published, failed or draft again, and what a batch adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import null_safe, split_join
from .rules import too_long_alone

#: Attempts at an answer of the right length.
ATTEMPTS = 2
#: Error kinds that leave the article a draft, and those that end the batch.
RETRY, ABORT = ("quota", "rede", "indisponivel"), ("quota", "desativado")


def error_kind(status: Column) -> Column:
    """What an HTTP status that isn't a success means; null is a failure before any answer."""
    return F.when(status.isNull(), "rede").when(status.isin(401, 403), "desativado").when(status.isin(402, 429), "quota").when(status >= 400, "indisponivel")


def provider_error(status: Column, body: Column, cause: Column) -> Column:
    """struct(kind, message) of a failed call: by its status and the answer's first 300 characters, or by what came before any answer."""
    said = F.when(status.isNull(), cause).otherwise(F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.left(F.coalesce(body, F.lit("")), F.lit(300))))
    return F.when(error_kind(status).isNotNull(), F.struct(error_kind(status).alias("kind"), said.alias("message")))


def error_destination(kind: Column) -> Column:
    return F.when(kind.isin(*RETRY, "desativado"), "draft").otherwise("failed_validation")


def next_step(ready: Column, answer_error: Column, check_error: Column, verdict_read: Column, failed_rules: Column, attempt: Column) -> Column:
    """struct(status, step) after an attempt.

    Not ready for adaptation: failed. An answer's error decides by its kind; a check's error that passes
    leaves a draft, as does a verdict that can't be read. No failed rule: published. Only length or ratio failed and attempts are left: written again. Else failed.
    """
    made = lambda status, step: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), F.lit(step).alias("step"))
    return (
        F.when(~F.coalesce(ready, F.lit(False)), made("failed_validation", "preflight"))
        .when(answer_error.isNotNull(), made(error_destination(answer_error), "answer_error"))
        .when(check_error.isNotNull() | ~F.coalesce(verdict_read, F.lit(False)), made("draft", "deferred"))
        .when(F.size(F.coalesce(failed_rules, F.array().cast("array<string>"))) == 0, made("published", "published"))
        .when(too_long_alone(failed_rules) & (attempt < ATTEMPTS), made("draft", "rewrite"))
        .otherwise(made("failed_validation", "rejected"))
    )


def final_states(attempts: DataFrame, key: str, attempt: str = "attempt", order: str | None = None) -> DataFrame:
    """(key, status, step, attempts, tokens_in, tokens_out) of each article: its last attempt's state (by ``order``, else by number); tokens add up over attempts, null where none said any.

    attempts has next_step's columns: ready, answer_error, check_error, verdict_read, failed_rules, tokens_in, tokens_out.
    """
    state = next_step(F.col("ready"), F.col("answer_error"), F.col("check_error"), F.col("verdict_read"), F.col("failed_rules"), F.col(attempt))
    rows = attempts.withColumn("state", state)
    made = rows.groupBy(key).agg(F.max_by("state", order or attempt).alias("state"), F.count(F.lit(1)).alias("attempts"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return made.select(key, "state.status", "state.step", "attempts", "tokens_in", "tokens_out")


def token_totals(states: DataFrame) -> DataFrame:
    """One row for the batch: nothing said counts as 0."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return states.agg(zero("tokens_in"), zero("tokens_out"), *(F.count_if(F.col("status") == s).alias(s) for s in ("published", "failed_validation", "draft")))


def _slots(items: DataFrame, batch: str, order: tuple[str, ...], error: str, limit: int, slot: Column | None) -> tuple[DataFrame, DataFrame]:
    """(items with __slot and __pos, where each batch stops: batch, __n, __stop struct(slot, pos) or null, aborted_by)."""
    rows = items.withColumn("__slot", F.date_trunc("hour", order[0]) if slot is None else slot)
    by = Window.partitionBy(batch, "__slot").orderBy(*order)
    bad = F.col(error).isNotNull().cast("long")
    rows = rows.withColumn("__pos", F.row_number().over(by)).withColumn("__island", F.sum(1 - bad).over(by))
    streak = F.sum(bad).over(Window.partitionBy(batch, "__slot", "__island").orderBy(*order))
    known = rows.withColumn("__streak", streak)
    first = lambda c: F.min(F.when(c, F.struct("__pos", F.col(error).alias("e"))))
    # A slot by itself: errors before its first success, errors after its last, its first error that ends the batch, its first streak.
    slots = known.groupBy(batch, "__slot").agg(
        F.count(F.lit(1)).alias("size"), F.count_if((F.col("__island") == 0) & F.col(error).isNotNull()).alias("lead"), F.max_by("__streak", "__pos").alias("tail"), first(F.col(error).isin(*ABORT)).alias("abort"), first(F.col("__streak") >= limit).alias("own"),
        F.collect_list(F.when((F.col("__island") == 0) & (F.col("__pos") < limit), F.struct("__pos", F.col(error).alias("e")))).alias("heads"),
    )
    # The run of errors that a slot begins with: the one before it, longer by whole slots of errors.
    line, upto = Window.partitionBy(batch).orderBy("__slot"), Window.partitionBy(batch, "__g").orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.col("lead") < F.col("size")
    run = slots.withColumn("__g", F.sum(broken.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__run", F.sum(F.when(broken, F.col("tail")).otherwise(F.col("size"))).over(upto))
    carried = run.withColumn("__carry", F.coalesce(F.lag("__run").over(line), F.lit(0)))
    at = F.greatest(F.lit(limit) - F.col("__carry"), F.lit(1))
    joined = F.when((F.col("__carry") > 0) & (F.col("lead") >= at), F.filter("heads", lambda h: h["__pos"] == at)[0])
    stop = F.array_min(F.array_compact(F.array("abort", "own", joined)))
    ends = carried.withColumn("__at", stop).groupBy(batch).agg(F.sum("size").alias("__n"), F.min(F.when(F.col("__at").isNotNull(), F.struct(F.col("__slot").alias("slot"), F.col("__at.__pos").alias("pos"), F.col("__at.e").alias("e")))).alias("__stop"))
    return rows.drop("__island"), ends.select(batch, "__n", F.struct("__stop.slot", "__stop.pos").alias("__stop"), F.col("__stop.e").alias("aborted_by"))


def breaker(items: DataFrame, batch: str, order: tuple[str, ...], error: str = "error", limit: int = 3, slot: Column | None = None) -> DataFrame:
    """items with processed: false for those after the batch's first error that ends it, or after ``limit`` errors in a row. error: kind or null; order is unique in a batch.

    A batch may hold all items: they are looked at in slots that follow the order (``slot``: not falling with it; by
    default the hour of the first order column), what a slot begins with comes from the sums of those before, and
    where a batch stops goes back to its items. Tasks hold a slot's items or a batch's slots, never a batch's items.
    """
    rows, ends = _slots(items, batch, order, error, limit, slot)
    total = ends.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    keyed = split_join(rows.withColumn("__b", null_safe(batch)), ends.select(null_safe(batch).alias("__b"), "__n", "__stop"), ["__b"], "__n", total)
    done = F.col("__stop.slot").isNull() | (F.struct(F.col("__slot").alias("slot"), F.col("__pos").alias("pos")) <= F.col("__stop"))
    return keyed.select(*items.columns, done.alias("processed"))


def deferred(items: DataFrame, batch: str, order: tuple[str, ...], error: str = "error", limit: int = 3, slot: Column | None = None) -> DataFrame:
    """(batch, seen, processed, deferred, aborted_by) of each batch: the items it left, and the kind of the error that ended it (null where none did)."""
    rows, ends = _slots(items, batch, order, error, limit, slot)
    sizes = rows.groupBy(null_safe(batch).alias("__b"), "__slot").agg(F.count(F.lit(1)).alias("n"))
    told = sizes.join(ends.withColumn("__b", null_safe(batch)), "__b")
    done = F.when(F.col("__stop.slot").isNull() | (F.col("__slot") < F.col("__stop.slot")), F.col("n")).when(F.col("__slot") == F.col("__stop.slot"), F.col("__stop.pos")).otherwise(F.lit(0))
    sums = told.groupBy(batch, "__b", "aborted_by").agg(F.sum("n").alias("seen"), F.sum(done).alias("processed"))
    return sums.select(batch, "seen", "processed", (F.col("seen") - F.col("processed")).alias("deferred"), "aborted_by")


def run_log(starts: DataFrame, ends: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs with finished_at, duration and crashed: a start without an end. Both have run and at (seconds); the first end counts."""
    closed = ends.groupBy(run).agg(F.min("at").alias("finished_at"))
    rows = starts.groupBy(run).agg(F.min("at").alias("started_at")).join(closed, run, "left")
    return rows.select(run, "started_at", "finished_at", (F.col("finished_at") - F.col("started_at")).alias("seconds"), F.col("finished_at").isNull().alias("crashed"))
