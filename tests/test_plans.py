"""Schedules, settings, page numbers, failed calls, robots files over time, on small cases against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.asof import last_before
from tessera.plans import adapt, reads, robots, schedule
from tessera.sources.settings import read_settings

UTC = dt.timezone.utc


def test_firings_and_runs(spark):
    """Runs belong to the firing before them, over midnight too; a trigger of one hour a day reaches to the next day's."""
    day = dt.datetime(2024, 5, 1)
    at = lambda *m: [day + dt.timedelta(minutes=x) for x in m]
    runs = spark.createDataFrame([("ingest", t) for t in at(0, 14, 15, 1439)] + [("adapt", t) for t in at(4, 1442)] + [("calendar", t) for t in at(419, 420, 1500)] + [("other", day)], "name string, ts timestamp_ntz")
    days = spark.createDataFrame([(day,), (day + dt.timedelta(days=1),)], "day timestamp_ntz")
    told = {(r["trigger"], (r["due"] - day).total_seconds() // 60): r["runs"] for r in schedule.answered(runs, days, "name", "ts").collect()}
    assert len(told) == 2 * (96 + 96 + 1)
    assert {k: n for k, n in told.items() if n} == {("ingest", 0): 2, ("ingest", 15): 1, ("ingest", 1425): 1, ("adapt", 1430): 1, ("calendar", 420): 2}


def test_settings_name_every_problem():
    good = {"SITE_URL": "https://portal.example//", "CRON_SECRET": "s" * 32, "SOURCE_B_ENABLED": "false"}
    found = read_settings(good)
    assert (found.site_url, found.on("a"), found.on("b"), found.on("B")) == ("https://portal.example", True, False, False) and "sss" not in repr(found)
    with pytest.raises(ValueError) as e:
        read_settings({"SITE_URL": "portal", "CRON_SECRET": "short-secret", "SOURCE_A_ENABLED": "yes"})
    assert all(x in str(e.value) for x in ("SITE_URL", "CRON_SECRET", "SOURCE_A_ENABLED")) and "short-secret" not in str(e.value)


def test_valid_pages(spark):
    articles = spark.createDataFrame([("published", "a")] * 25 + [("published", "b"), ("published", None), ("draft", "c")], "status string, category_slug string")
    asked = [("a", 3), ("a", 4), ("a", 0), ("b", 1), ("b", 2), ("c", 1), ("c", 2), (None, 3), (None, 4)]
    got = {(r["category"], r["number"]): (r["pages"], r["valid"]) for r in reads.valid_pages(articles, spark.createDataFrame(asked, "category string, number int")).collect()}
    assert got == {("a", 3): (3, True), ("a", 4): (3, False), ("a", 0): (3, False), ("b", 1): (1, True), ("b", 2): (1, False), ("c", 1): (1, True), ("c", 2): (1, False), (None, 3): (3, True), (None, 4): (3, False)}


def test_failed_calls(spark):
    rows = [(200, "fine", None), (429, "x" * 400, None), (403, None, None), (None, None, "DNS"), (503, "down", "no")]
    df = spark.createDataFrame(rows, "status int, body string, cause string")
    got = [r["e"] and tuple(r["e"]) for r in df.select(adapt.provider_error(F.col("status"), F.col("body"), F.col("cause")).alias("e")).collect()]
    assert got == [None, ("quota", "HTTP 429: " + "x" * 300), ("desativado", "HTTP 403: "), ("rede", "DNS"), ("indisponivel", "HTTP 503: down")]


def test_last_fact_before_a_time(spark):
    """Against a scan of all facts: ties, facts at the very time and at the reach's end, slots' edges, null keys."""
    rng, reach = random.Random(2), 100
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=s)
    facts = [(rng.choice("ab"), rng.randrange(0, 900, 10), k) for k in range(60)] + [(None, 5, 99)]
    probes = [(k, rng.choice(["a", "b", "c", None]), rng.randrange(-50, 1100, 5)) for k in range(200)]
    got = last_before(spark.createDataFrame([(k, c, at(s)) for k, c, s in probes], "k int, key string, at timestamp").repartition(3), spark.createDataFrame([(c, at(s), n, n) for c, s, n in facts], "key string, since timestamp, n int, rank int").repartition(3), "key", "at", "since", reach, ("n",), "rank")
    want = {k: max(((s, n) for c, s, n in facts if c is not None and c == key and s <= t and t - s <= reach), default=(None, None))[1] for k, key, t in probes}
    assert {r["k"]: r["n"] for r in got.select("k", "n").collect()} == want and got.count() == len(probes)


def test_robots_over_time(spark):
    """A file holds six hours, a missing one too (all allowed), a failure five minutes (none); a later failure replaces a file; without a fetch nothing is known."""
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=m)
    text = "User-agent: *\nDisallow: /no"
    fetches = spark.createDataFrame([("a.example", at(0), 200, text, 1), ("b.example", at(0), 404, None, 2), ("A.example", at(100), 503, None, 3), ("c.example", at(0), None, None, 4)], "host string, fetched_at timestamp, status int, text string, fetch_id long")
    visits = [(1, "https://a.example/no/x", 1), (2, "https://A.example/yes", 99), (3, "https://a.example/yes", 104), (4, "https://a.example/yes", 106), (5, "http://b.example/no", 359), (6, "http://b.example/no", 361), (7, "http://c.example/", 4), (8, "http://c.example/", 5), (9, "http://d.example/", 1), (10, "no address", 1)]
    got = {r["k"]: (r["mode"], r["allowed"]) for r in robots.decide_at(spark.createDataFrame([(k, u, at(m)) for k, u, m in visits], "k int, url string, at timestamp"), fetches, "Bot/1").collect()}
    assert got == {1: ("rules", False), 2: ("rules", True), 3: ("none", False), 4: ("stale", None), 5: ("all", True), 6: ("stale", None), 7: ("none", False), 8: ("stale", None), 9: ("stale", None), 10: ("stale", None)}
