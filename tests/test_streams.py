"""Streams against the same rows in one piece: restarts, overlaps, late rows, bounded state."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import adapt
from tessera.streaming import ingest, sink, states, windows

from .test_queries import SF

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, ts timestamp, article string, ready boolean, answer_error string, check_error string, verdict_read boolean, failed_rules array<string>, attempt long, tokens_in long, tokens_out long"


def attempt(k, minute, article, error=None, failed=(), tokens=(1, None)):
    return (k, DAY + dt.timedelta(minutes=minute), article, True, error, None, True, list(failed), k % 2 + 1, *tokens)


def slices(spark, path, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/slice={k}")


def read(spark, path, pattern="slice=*"):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/{pattern}")


PARTS = [
    [attempt(1, 0, "a", "rede"), attempt(2, 1, "b"), attempt(3, 2, "c", "quota"), attempt(4, 3, None, "rede")],
    [attempt(5, 20, "a", "rede"), attempt(6, 21, "c", failed=["numeros"], tokens=(5, 6)), attempt(7, 21, "d", "rede")],
    [attempt(8, 45, "e"), attempt(9, 90, "d", "rede"), attempt(10, 90, "d", tokens=(None, 2))],
    [attempt(11, 300, "f", "rede"), attempt(12, 299, "f", failed=["comprimento"])],
]


def run(spark, source, out):
    made = states.article_states(read(spark, source), "article", "ts", "id")
    q = states.run_states(made, f"{out}/table", f"{out}/log")
    q.awaitTermination()
    return sink.batches(spark, f"{out}/table", states.schema("article", "string"))


def test_states_with_timers(spark, tmp_path):
    """Equal to the batch's final states; drafts are ready 30 minutes after their last attempt; a restart goes on from the checkpoint and changes nothing."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    slices(spark, source, PARTS[:2])
    first = run(spark, source, out)
    assert {(r["article"], r["status"], r["attempts"]) for r in sink.latest(first.filter("event = 'attempt'"), ["article"]).collect()} == {("a", "draft", 2), ("b", "published", 1), ("c", "failed_validation", 2), ("d", "draft", 1), (None, "draft", 1)}
    n = first.count()
    assert run(spark, source, out).count() == n
    for k, rows in enumerate(PARTS[2:], 2):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/slice={k}")
    rows = run(spark, source, out)
    told = sink.latest(rows.filter("event = 'attempt'"), ["article"])
    every = spark.createDataFrame(sum(PARTS, []), SCHEMA)
    want = adapt.final_states(every, "article", "attempt", order="id")
    assert sorted(map(str, told.select(*want.columns).collect())) == sorted(map(str, want.withColumn("status", F.when(F.col("article") == "f", "draft").otherwise(F.col("status"))).withColumn("step", F.when(F.col("article") == "f", "answer_error").otherwise(F.col("step"))).collect()))
    ready = {(r["article"], r["ready_ms"]) for r in rows.filter("event = 'ready'").collect()}
    minute = lambda m: int((DAY + dt.timedelta(minutes=m)).timestamp() * 1000)
    assert ready == {("a", minute(50)), (None, minute(33))}  # c and d were tried again before the watermark got to their ends, f waits for a later one
    assert {r["article"]: r["steps"] for r in told.collect()}["d"] == "answer_error:2,published:1"


def test_windows_and_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    slices(spark, source, [PARTS[0], PARTS[1], [attempt(20, 3000, "x", "rede")], [attempt(21, 3001, "x")], [attempt(22, 5, "late"), attempt(23, 3002, "x")]])
    rows = windows.observed(read(spark, source).withColumn("bad", F.col("answer_error").isNotNull()), "ts")
    q = sink.write_batches(windows.failure_windows(rows, "ts", "bad"), f"{out}/table", f"{out}/log")
    q.awaitTermination()
    told = sink.latest(sink.batches(spark, f"{out}/table", "started timestamp, runs long, failures long"), ["started"])
    assert sorted((r["runs"], r["failures"]) for r in told.collect()) == [(3, 1), (7, 5)] and windows.rows_seen(q) == 11


@pytest.mark.parametrize("event_time", [None, "ts"])
def test_merge_of_overlapping_runs(spark, tmp_path, event_time):
    """Overlapping runs write each key once; with event time the state holds only keys that the watermark hasn't passed."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[attempt(k, 60 * k, "a") for k in range(20 * p - (5 if p else 0), 20 * p + 20)] for p in range(4)]
    slices(spark, source, parts)
    held = []
    for name, pattern in (("a", "slice=[012]"), ("b", "slice=[123]"), ("b", "slice=[123]")):
        q = ingest.merge_stream(read(spark, source, pattern), f"{out}/table", f"{out}/log-{name}", "id", "ts", event_time=event_time, delay="10 hours")
        q.awaitTermination()
        held += [o.numRowsTotal for p in q.recentProgress if p.numInputRows for o in p.stateOperators]
    table = spark.read.parquet(f"{out}/table")
    assert table.count() == table.select("id").distinct().count() == 80
    assert not held or 20 <= max(held) < 50


def test_clamped_event_times(spark):
    now = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    rows = [(1, None), (2, now + dt.timedelta(days=1)), (3, now + dt.timedelta(days=3)), (4, now - dt.timedelta(days=900))]
    got = {r["k"]: r["ts"] for r in ingest.clamp_event_time(spark.createDataFrame(rows, "k long, ts timestamp"), "ts", now).select("k", F.unix_seconds("ts").alias("ts")).collect()}
    at = lambda t: int(t.timestamp())
    assert got == {1: at(now), 2: at(rows[1][1]), 3: at(now), 4: at(rows[3][1])}


@pytest.mark.parametrize("name", ["stream_failures", "stream_run_log", "stream_states"])
def test_slices_of_several_files_are_one_batch(spark, tmp_path, monkeypatch, name):
    """Events in several files, and slices too: batches follow the slices, as in the SQL."""
    from tessera import queries_stream
    from tessera.queries import ORACLE_SQL, QUERIES

    from .oracle import differences

    monkeypatch.setattr(queries_stream, "FILE_ROWS", 100, raising=False)
    spark.read.parquet(f"{SF}/events.parquet").repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert (d := differences(QUERIES[name](spark, str(tmp_path)), c, ORACLE_SQL[name])) is None, d


def test_slices_are_padded_with_empty_files(spark, tmp_path):
    from tessera import queries_stream

    queries_stream.write_slice(spark.range(3).coalesce(1), f"{tmp_path}/a", 5)
    queries_stream.write_slice(spark.range(0), f"{tmp_path}/b", 3)
    got = [spark.read.parquet(f"{tmp_path}/{x}") for x in "ab"]
    assert [(df.count(), len(df.inputFiles())) for df in got] == [(3, 5), (0, 3)]


def test_states_are_read_and_written_by_group(spark, tmp_path, monkeypatch):
    """One list a group, whatever its articles: a call to the state a batch, and the same rows from one group as from many."""
    calls = []

    class Handle:
        def getListState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return iter(())

        def put(self, rows):
            calls.append(len(rows))

        def listTimers(self):
            return iter(())

        def registerTimer(self, at):
            calls.append(at)

    made = states.ArticleStates("article", "string", 100)
    made.init(Handle())
    rows = [{"article": str(k % 50), "at_ms": k, "rank": k, "status": "draft", "step": "deferred", "tokens_in": None, "tokens_out": k} for k in range(500)]
    assert len(list(made.handleInputRows((0,), iter(rows), None))) == 50 and calls == ["get", 50, 550]
    got = []
    for n in (1, 64):
        monkeypatch.setattr(states, "GROUPS", n)
        slices(spark, f"{tmp_path}/in{n}", PARTS)
        got.append(sorted(map(str, run(spark, f"{tmp_path}/in{n}", f"{tmp_path}/out{n}").drop("batch").collect())))
    assert got[0] == got[1] and sum("ready" in r.split("event=")[1][:8] for r in got[0]) == 2
