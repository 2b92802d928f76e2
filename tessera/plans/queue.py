"""Work queue, requeue, failure streaks, health and calendar coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import MIN_SOURCE, TRANSIENT
from ..functions.text import shorten


def work_queue(articles: DataFrame, now: int, k: int = 5, cooldown: int = 1800) -> DataFrame:
    """Drafts that were never tried or not within the cool-down, newest first, 25 at most."""
    ready = (F.col("status") == "draft") & (F.col("attempted_at").isNull() | (F.col("attempted_at") < now - cooldown))
    return articles.filter(ready).orderBy(F.desc("published_at"), F.desc("doc_id")).limit(min(max(k, 1), 25))


def requeue(articles: DataFrame, now: int, days: int = 3, attempts: int = 2, k: int = 50) -> DataFrame:
    """Failed articles of the last days whose causes all pass, with attempts to spare, the newest k: back to draft, one attempt more."""
    causes = F.expr("size(validation_errors) > 0") & F.forall("validation_errors", lambda e: F.exists(F.array(*map(F.lit, TRANSIENT)), lambda c: F.contains(e, c)))
    rows = articles.filter((F.col("status") == "failed_validation") & (F.col("published_at") >= now - days * 86400) & (F.coalesce("attempts", F.lit(0)) < attempts) & causes)
    return rows.orderBy(F.desc("published_at"), F.desc("doc_id")).limit(k).withColumn("status", F.lit("draft")).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)


def enrichment_queue(articles: DataFrame, now: int, source: str, days: int = 7, least: int = MIN_SOURCE, k: int = 12) -> DataFrame:
    """Articles of an excerpt-only source, fetched in the last days, without an image or with too little text: the newest k."""
    wants = F.col("image_url").isNull() | (F.col("source_length") < least)
    return articles.filter((F.col("source") == source) & wants & (F.col("fetched_at") > now - days * 86400)).orderBy(F.desc("published_at"), F.desc("doc_id")).limit(k)


def enriched(articles: DataFrame, pages: DataFrame, key: str, least: int = 400) -> DataFrame:
    """articles with image_url, source_excerpt and source_length from their pages (key, og_image, og_description, body): body over ``least`` characters, else description, where it is longer than what is there."""
    found = pages.select(F.col(key).alias("__key"), "og_image", "og_description", "body")
    rows = articles.join(found, F.col(key) == F.col("__key"), "left")
    held = F.length(F.coalesce("source_excerpt", F.lit("")))
    body = F.when((F.length("body") > least) & (F.length("body") > held), F.col("body"))
    best = F.coalesce(body, F.when(F.length("og_description") > held, F.col("og_description")))
    made = {"image_url": F.coalesce("og_image", "image_url"), "source_excerpt": F.coalesce(shorten(best, 6000), F.col("source_excerpt")), "source_length": F.coalesce(F.length(best).cast("long"), F.col("source_length"))}
    return rows.select(*(made[c].alias(c) if c in made else F.col(c) for c in articles.columns))


def failure_streaks(runs: DataFrame, source: str, failed: str, order: tuple[str, ...], limit: int = 3, slot: Column | None = None) -> DataFrame:
    """(source, longest, tripped): each failing source's longest run of failures; the breaker trips at limit.

    A source may hold a third of all runs, so runs are counted in slots that follow the order (``slot``: not falling with it; by default the
    hour of the first order column) and a source's slots are then put together: its tasks are the slots. A null ``failed`` is a success.
    """
    bad = F.coalesce(F.col(failed), F.lit(False))
    rows = runs.withColumn("__slot", F.date_trunc("hour", order[0]) if slot is None else slot).withColumn("__bad", bad.cast("int"))
    by = Window.partitionBy(source, "__slot").orderBy(*order)
    rows = rows.withColumn("__island", F.sum(1 - F.col("__bad")).over(by))
    islands = rows.groupBy(source, "__slot", "__island").agg(F.sum("__bad").alias("n"), F.count(F.lit(1)).alias("size"))
    # A slot's first island (0) is the failures before any success; the last one those after the last success.
    slots = islands.groupBy(source, "__slot").agg(F.sum("size").alias("size"), F.coalesce(F.max(F.when(F.col("__island") == 0, F.col("n"))), F.lit(0)).alias("lead"), F.max_by("n", "__island").alias("tail"), F.max("n").alias("best"))
    state = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def add(acc: Column, x: Column) -> Column:
        whole = acc["run"] + x["lead"]
        return F.struct(F.when(x["lead"] == x["size"], whole).otherwise(x["tail"]).alias("run"), F.greatest(acc["best"], whole, x["best"]).alias("best"))

    listed = slots.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("__slot", "size", "lead", "tail", "best"))).alias("__all"))
    longest = listed.select(source, F.aggregate("__all", state, add)["best"].alias("longest"))
    return longest.filter("longest > 0").withColumn("tripped", F.col("longest") >= limit)


def coverage(days: DataFrame, today: str) -> DataFrame:
    """One row: stored days, whether today is one, days from today on, last day and days left (alert under 7)."""
    d = F.to_date(F.lit(today))
    return days.agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("day") == d).alias("today"), F.count_if(F.col("day") >= d).alias("ahead"), F.max("day").cast("string").alias("last_day"), F.datediff(F.max("day"), d).alias("days_left")).withColumn("alert", F.col("days_left") < 7)


def month_completeness(days: DataFrame) -> DataFrame:
    rows = days.groupBy(F.trunc("day", "month").alias("m")).agg(F.countDistinct("day").alias("n"))
    return rows.select(F.date_format("m", "yyyy-MM").alias("month"), "n", F.day(F.last_day("m")).alias("expected")).withColumn("complete", F.col("n") == F.col("expected"))


def health(articles: DataFrame, runs: DataFrame, days: DataFrame, now: str, stale_minutes: int = 90) -> DataFrame:
    """One row: counts by status, failed runs in six hours, the latest run and the minutes since, coverage, problems, a verdict and its HTTP status.

    Stopped: nothing published, no run, or none in stale_minutes. Degraded: any other problem (no day for today, under seven days left, three failed runs).
    """
    at = F.lit(now).cast("timestamp_ntz")
    a = articles.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("draft", "published", "failed_validation")))
    r = runs.agg(
        F.count_if((F.col("event_type") == "error") & (F.col("ts") >= at - F.expr("interval 6 hours")) & (F.col("ts") <= at)).alias("failures"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_run"),
        F.timestamp_diff("minute", F.max("ts"), at).alias("idle_minutes"),
    )
    c = coverage(days, now[:10])
    one = a.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k").drop("k")  # three single rows
    idle = F.col("idle_minutes").isNull() | (F.col("idle_minutes") > stale_minutes)
    problems = F.array_compact(F.array(
        F.when(F.col("idle_minutes").isNull(), "no run").when(idle, F.concat(F.lit("no run for "), F.col("idle_minutes").cast("string"), F.lit(" min"))), F.when(F.col("n_published") == 0, "nothing published"),
        F.when(F.col("today") == 0, "no day for today").when(F.col("days_left") < 7, F.concat(F.col("days_left").cast("string"), F.lit(" days left"))), F.when(F.col("failures") >= 3, F.concat(F.col("failures").cast("string"), F.lit(" failed runs"))),
    ))
    verdict = F.when(idle | (F.col("n_published") == 0), "parado").when(F.size(problems) > 0, "degradado").otherwise("ok")
    return one.withColumn("problems", F.array_join(problems, "; ")).withColumn("verdict", verdict).withColumn("http_status", F.when(F.col("verdict") == "parado", 503).otherwise(200))
