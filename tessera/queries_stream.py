"""Queries over events as streams: states with timers, event-time windows, duplicates between overlapping runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import adapt
from .registry import query
from .sources.shared import fresh_path
from .sources.tables import table
from .streaming import ingest, runlog, sink, states, windows

#: Slices of time in which events come, every LATE-th of them in the last slice, and rows that a slice's file has at most, roughly.
SLICES, LATE, FILE_ROWS = 4, 97, 100_000


def write_slice(rows: DataFrame, path: str, files: int) -> None:
    """rows as just so many files, empty ones among them if need be: a stream that reads so many at a time has the folder as one batch."""
    rows.repartition(files).write.parquet(path)
    for _ in range(files - len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())):
        rows.limit(0).write.mode("append").parquet(path)


def slice_files(s: SparkSession, path: str) -> int:
    """How many files each slice has."""
    return len(s.read.parquet(f"{path}/slice=0").inputFiles())


def event_slices(s: SparkSession, d: str, late: bool = False) -> str:
    """The events as files in folders slice=0, 1, ... by time, each with as many files, written one after another, so that a stream reads them in this order; with ``late`` some come in the last one."""
    path, events = fresh_path(s, "events"), table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, -(-(ends["b"] - ends["a"] + 1) // SLICES)) if ends["a"] is not None else 1
    files = max(1, -(-ends["n"] // (SLICES * FILE_ROWS)))
    part = F.floor((F.unix_micros("ts") - (ends["a"] or 0)) / width).cast("int")
    part = F.when(F.col("event_id") % LATE == 0, SLICES - 1).otherwise(part) if late else part
    for k in range(SLICES):
        write_slice(events.filter(part == k), f"{path}/slice={k}", files)
    return path


def read_slices(s: SparkSession, path: str, pattern: str = "slice=*", slices: int = 1) -> DataFrame:
    """The slices as a stream, so many a batch."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return s.readStream.schema(schema).option("maxFilesPerTrigger", slices * slice_files(s, path)).parquet(f"{path}/{pattern}")


#: SQL: which slice an event comes in, for slices of equal time.
SLICED_SQL = f"""with m as (select min(epoch_us(ts)) a, greatest(1, (max(epoch_us(ts)) - min(epoch_us(ts)) + 1 + {SLICES - 1}) // {SLICES}) w, max(ts) last from events),
 e as (select events.*, (epoch_us(ts) - a) // w slice, m.last from events, m)"""


def event_attempts(events: DataFrame) -> DataFrame:
    """Events as attempts at the article user_id: kinds of event are kinds of outcome."""
    i, kind = F.col("event_id"), F.col("event_type")
    failed = F.when(kind == "click", F.array(F.lit("comprimento"))).when((kind == "purchase") & (i % 2 == 0), F.array(F.lit("numeros"))).otherwise(F.array().cast("array<string>"))
    status = F.when(kind == "error", F.when(i % 3 == 0, 429).when(i % 3 == 1, 401).otherwise(500))
    return events.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (i % 3 + 1).alias("attempt"), (i % 11 != 0).alias("ready"), adapt.error_kind(F.coalesce(status, F.lit(0))).alias("answer_error"),
        F.when(kind == "signup", adapt.error_kind(F.lit(None).cast("int"))).alias("check_error"), F.lit(True).alias("verdict_read"), failed.alias("failed_rules"), F.when(kind != "click", F.length("props").cast("long")).alias("tokens_in"), F.when(kind != "view", i % 7).alias("tokens_out"),
    )


ATTEMPTS_SQL = """ a as (select *, case when event_id % 11 = 0 then 'failed_validation' when event_type in ('error', 'signup') then 'draft' when event_type = 'view' or event_type = 'purchase' and event_id % 2 = 1 then 'published' when event_type = 'click' and event_id % 3 + 1 < 2 then 'draft' else 'failed_validation' end status,
 case when event_id % 11 = 0 then 'preflight' when event_type = 'error' then 'answer_error' when event_type = 'signup' then 'deferred' when event_type = 'view' or event_type = 'purchase' and event_id % 2 = 1 then 'published' when event_type = 'click' and event_id % 3 + 1 < 2 then 'rewrite' else 'rejected' end step,
 case when event_type <> 'click' then length(props) end tokens_in, case when event_type <> 'view' then event_id % 7 end tokens_out from e),
 f as (select user_id, arg_max(status, row(ts, event_id)) status, arg_max(step, row(ts, event_id)) step, count(*) attempts, sum(tokens_in)::bigint tokens_in, sum(tokens_out)::bigint tokens_out, max(ts) last_at, max(last) last from a group by 1)"""


@query("stream_states", SLICED_SQL + "," + ATTEMPTS_SQL + """, g as (select user_id, array_to_string(list_sort(list(concat(step, ':', n))), ',') steps from (select user_id, step, count(*) n from a group by 1, 2) group by 1)
 select user_id, status, step, attempts, tokens_in, tokens_out, steps, status = 'draft' and epoch_ms(last_at) + 1800000 < epoch_ms(last) - 600000 as cooled from f join g using (user_id)""")
def stream_states(s, d):
    """Each article's state after all batches, how often each step was taken, and whether a draft's cool-down is over."""
    path, out = event_slices(s, d), fresh_path(s, "states")
    made = states.article_states(event_attempts(read_slices(s, path)), "user_id", "ts", "event_id")
    states.run_states(made, f"{out}/table", f"{out}/log").awaitTermination()
    rows = sink.batches(s, f"{out}/table", states.schema("user_id", "long"))
    told = sink.latest(rows.filter("event = 'attempt'"), ["user_id"])
    ready = rows.filter("event = 'ready'").select("user_id", "attempts", F.lit(True).alias("cooled")).distinct()
    return told.join(ready, ["user_id", "attempts"], "left").select("user_id", "status", "step", "attempts", "tokens_in", "tokens_out", "steps", F.coalesce("cooled", F.lit(False)).alias("cooled"))


@query("stream_failures", SLICED_SQL + f""", x as (select *, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') started, event_id % {LATE} = 0 and slice < {SLICES - 1} delayed from e),
 y as (select *, delayed and started + interval 6 hour <= (select max(ts) from x where slice < {SLICES - 2} and not delayed) - interval 1 hour late from x)
 select strftime(started, '%Y-%m-%d %H:%M') as started, count(*) as runs, count(*) filter (event_type = 'error') as failures, (select count(*) from y where late) as late_rows from y where not late group by 1""")
def stream_failures(s, d):
    """Failures in windows of six hours; rows that come after their window has gone are counted."""
    path, out = event_slices(s, d, late=True), fresh_path(s, "windows")
    rows = windows.observed(read_slices(s, path).withColumn("bad", F.col("event_type") == "error"), "ts")
    run = sink.write_batches(windows.failure_windows(rows, "ts", "bad"), f"{out}/table", f"{out}/log")
    run.awaitTermination()
    told = sink.latest(sink.batches(s, f"{out}/table", "started timestamp, runs long, failures long"), ["started"])
    counted = told.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("n")).first()["n"]
    return told.select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "runs", "failures", F.lit(windows.rows_seen(run) - counted).alias("late_rows"))


@query("stream_quiet", """with e as (select event_type, ts, case when ts < lag(ts) over (partition by event_type order by ts, event_id) + interval 90 minute then 0 else 1 end fresh, max(ts) over () last from events),
 g as (select *, sum(fresh) over (partition by event_type order by ts rows unbounded preceding) spell from e),
 h as (select event_type, spell, min(ts) a, max(ts) + interval 90 minute b, count(*) runs, max(last) last from g group by 1, 2)
 select event_type, strftime(a, '%Y-%m-%d %H:%M:%S') as started, strftime(b, '%Y-%m-%d %H:%M:%S') as stale_from, runs from h where epoch_ms(b) <= epoch_ms(last) - 3600000""")
def stream_quiet(s, d):
    """Spells of each kind of run without a gap of 90 minutes, and from when on it was stale."""
    path, out = event_slices(s, d), fresh_path(s, "spells")
    sink.write_batches(windows.busy_spells(read_slices(s, path), "event_type", "ts"), f"{out}/table", f"{out}/log", "append").awaitTermination()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sink.batches(s, f"{out}/table", "event_type string, started timestamp, stale_from timestamp, runs long").select("event_type", text("started"), text("stale_from"), "runs")


@query("stream_overlap", "select event_id, event_type, 1::bigint as times from events")
def stream_overlap(s, d):
    """Two runs over overlapping slices, each of which also gets its first slice twice: every event stands once."""
    path, out = event_slices(s, d), fresh_path(s, "overlap")
    again = s.read.parquet(f"{path}/slice=1")
    write_slice(again, f"{path}/again=1", slice_files(s, path))
    for run, pattern in (("a", "{slice=0,slice=1,slice=2,again=1}"), ("b", "{slice=1,again=1,slice=2,slice=3}")):
        ingest.merge_stream(read_slices(s, path, pattern, 2), f"{out}/table", f"{out}/log-{run}", "event_id", "ts", event_time="ts", delay="1 day").awaitTermination()
    return s.read.parquet(f"{out}/table").groupBy("event_id", "event_type").agg(F.count(F.lit(1)).alias("times"))


@query("stream_run_log", SLICED_SQL + f", s as (select slice, count(*) n, count(*) filter (event_type = 'error') bad from e group by 1) select 'events' as query, count(*) as batches, sum(n)::bigint as rows_in, sum(bad)::bigint as failures, false as crashed from s")
def stream_run_log(s, d):
    """What the listener wrote about a run over the events: batches, rows and failures, counted while they went by."""
    path, out = event_slices(s, d), fresh_path(s, "runs")
    log = runlog.RunLog(s, f"{out}/log")
    s.streams.addListener(log)
    try:
        rows = read_slices(s, path).observe("seen", F.count_if(F.col("event_type") == "error").alias("failures"))
        rows.writeStream.queryName("events").format("parquet").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start(f"{out}/table").awaitTermination()
        runlog.wait_for(log, 1)
    finally:
        s.streams.removeListener(log)
    return log.rows().select("query", "batches", "rows_in", F.col("seen")["seen.failures"].alias("failures"), "crashed")
