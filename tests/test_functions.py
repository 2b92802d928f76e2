"""Functions and operators on small cases: nulls, empty texts, ties, repeats, empty tables."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, html, text, url
from tessera.operators import asof, merge
from tessera.plans import classify, editorial, queue, reads, robots, rules
from tessera.sources import rss
from tessera.streaming.ingest import merge_stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("Olá, Mundo!", "ola-mundo"), ("São João d'Arc", "sao-joao-darc"), ("", ""), ("!!!", ""), (None, None), ("a" * 90, "a" * 80), ("palavra " * 20, "-".join(["palavra"] * 10))],
)
def test_slug(spark, given, want):
    got = one(spark, given, text.slugify)
    assert got == want and (got is None or len(got) <= 80)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("HTTPS://Example.COM:443/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"), ("http://u:p@h.org", "http://h.org/"), ("ftp://h.org/", None), ("", None), (None, None), ("https://h.org/x?fbclid=1", "https://h.org/x"),
    ],
)
def test_canonical(spark, given, want):
    got = one(spark, given, url.canonical)
    assert got == want and (got is None or one(spark, got, url.canonical) == got)


@pytest.mark.parametrize(("given", "want"), [("Šimon Dvořák", "simon-dvorak"), ("Ảo ẟ ñÑ", "ao-nn"), ("e\u0301tude", "etude")])
def test_every_accent_folds(spark, given, want):
    assert one(spark, given, text.slugify) == want


def test_shorten_and_minutes(spark):
    assert one(spark, "curto", lambda c: text.shorten(c, 10)) == "curto"
    assert one(spark, "uma frase, bem comprida", lambda c: text.shorten(c, 12)) == "uma frase…"
    assert one(spark, "", text.reading_minutes) == 1


def test_dates(spark):
    now = F.lit(1706659200)
    read = lambda v: one(spark, v, lambda c: dates.rfc822_seconds(c, now))
    assert read("Mon, 29 Jan 2024 10:00:00 GMT") == 1706522400
    assert read("Sat, 29 Jan 2124 10:00:00 GMT") == read("nonsense") == read(None) == 1706659200


def test_html():
    found = html.open_graph("<head><meta property='og:title' content='T'><meta property='og:title' content='U'><meta name='twitter:description' content='D'></head><meta name='author' content='X'>")
    assert found == ("T", "D", None, None, None) and html.open_graph(None) == (None,) * 5
    assert "no()" not in html.html_text("a<script>no()</script><p>b &amp; c</p>") and html.html_text(None) is None and html.html_text("<p>a</p><p>b</p>") == "a\n\nb"
    long, box = "<p>" + "x " * 60 + "</p>", "<div class='a entry-content'>"
    assert html.article_body(long + box + long * 3 + "<aside>" + long + "</aside></div>")[1:] == (3, True)
    assert html.article_body(long * 2 + box + long + "</div>")[1:] == (3, False) and html.article_body(box + long + "<p>short" + long)[1:] == (2, True) and html.article_body("") == (None, 0, None)
    rows, headings = html.tables("<h1>A <b>b</b></h1><table><tr><td>1<br>2</td><td><p>x</p></td><td></td><td>&nbsp;y</td></tr><tr><td>z</td></tr></table>")
    assert rows == [[["1", "2"], ["x"], [], ["y"]]] and headings == ["A b"] and html.tables(None) == ([], [])


def test_category(spark):
    path = lambda v: one(spark, v, classify.path_category)
    assert path("https://h/vatican/x") == "vaticano" and path("https://h/x/saints/y") == "santos" and path("https://h/x/y/saints") is None and path(None) is None
    assert one(spark, "Pope at the cathedral: a massacre", classify.lexicon_category) == "vaticano" and one(spark, None, classify.lexicon_category) is None


def test_robots(spark):
    text_ = "User-agent: *\nDisallow: /\nuser-agent: Bot\nUser-Agent: two\nDisallow: /a\nAllow: /a*.html # x\nDisallow: /a*.html\n\nUser-agent: bot\nDisallow: /q?(x$"
    files = spark.createDataFrame([("h", text_), ("open", None)], "host string, text string")
    pages = spark.createDataFrame([(1, "https://h/a/b"), (2, "https://H/a/b.html"), (3, "https://h/z"), (4, None), (5, "https://h/q?(x"), (6, "https://h/q?(xy"), (7, "https://open/a"), (8, "https://other/a")], "i int, url string")
    got = {r["i"]: r["allowed"] for r in robots.decide(pages, files, "Bot/2").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True}
    assert {r["i"]: r["allowed"] for r in robots.decide(pages, files, "else").collect()} == {k: k in (4, 7, 8) for k in range(1, 9)}


def test_classify_batch(spark):
    target = spark.createDataFrame([("k1", "x"), ("k1", "x")], "key string, hash string")
    batch = spark.createDataFrame([("k1", "x", 1), ("k1", "y", 2), ("k2", "z", 3), ("k2", "z", 4)], "key string, hash string, pos int")
    got = {r["pos"]: r["outcome"] for r in merge.classify_batch(target, batch, "key", "pos", "hash").collect()}
    assert got == {1: "duplicate", 2: "updated", 3: "new", 4: "duplicate"}
    once = merge.insert_new(target.limit(1), batch, "key", "pos")
    assert once.count() == 2 and merge.insert_new(once, batch, "key", "pos").count() == 2
    assert merge.classify_batch(target, batch.limit(0), "key", "pos").count() == 0


def test_null_keys_and_contents_stay(spark):
    target = spark.createDataFrame([("k1", None), (None, "x")], "key string, hash string")
    batch = spark.createDataFrame([("k1", None, 1), ("k1", "y", 2), (None, "x", 3), ("k2", None, 4), ("k2", None, 4)], "key string, hash string, pos int")
    got = collections.Counter((r["pos"], r["outcome"]) for r in merge.classify_batch(target, batch, "key", "pos", "hash").collect())
    assert got == {(1, "duplicate"): 1, (2, "updated"): 1, (3, "duplicate"): 1, (4, "new"): 2}
    assert merge.insert_new(target, batch.withColumnRenamed("pos", "p"), "key", "p").count() == 3
    slugs = spark.createDataFrame([(None, 1, "s"), ("", 2, "t"), ("a", 3, "u"), ("a", 3, "v")], "slug string, n int, h string")
    got = sorted(r["final_slug"] for r in merge.free_slugs(slugs, slugs.limit(0), "slug", "n", "h").collect())
    assert len(got) == 4 and got[2:] == ["noticia-s", "noticia-t"] and "a" in got
    repeated = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, name string, n int")
    assert merge.coalescing_upsert(repeated.limit(0), repeated, "k", ("n",), ("name",)).count() == 1


def test_feeds(spark):
    xml = '<rss xmlns:media="m" xmlns:content="c"><channel><item><title>2026</title><guid isPermaLink="false">id-77</guid></item><item><title>A &amp; B</title><guid>https://h/1/?utm_x=1</guid><content:encoded>&lt;p&gt;t&lt;/p&gt;</content:encoded><media:content url="https://i/1.jpg"/><media:content url="https://i/2.jpg"/></item></channel></rss>'
    items, broken = rss.feed_items(spark.createDataFrame([(1, xml), (2, "<html/>"), (3, None)], "i int, xml string"))
    good, bad = rss.full_text_items(items, "a", "A", F.lit(1706659200))
    r = good.first()
    assert good.count() == 1 and (r["title"], r["url"], r["excerpt"], r["image_url"], r["published_at"]) == ("A & B", "https://h/1", "t", "https://i/1.jpg", 1706659200) and bad.count() == 1 and broken.count() == 2
    assert rss.excerpt_items(items, "b", "B", F.lit(0))[0].count() == 0


def test_adoption(spark):
    schema = "key string, slug string, content string, source string, title string"
    target = spark.createDataFrame([("k1", "s1", "c", "a", "t")], schema)
    batch = spark.createDataFrame([("k2", "s1", "c", "a", "t", 1), ("k3", "s1", "c", "b", "t", 2), ("k1", "s1", "d", "a", "t", 3), (None, "", None, None, None, 4), ("k5", "s5", "c", "a", "t", 5), ("k6", "s5", "c", "a", "t", 6)], schema + ", position int")
    got = {r["position"]: (r["outcome"], r["final_slug"]) for r in merge.adopt(target, batch).collect()}
    assert got == {1: ("adopted", "s1"), 2: ("new", "s1-k3"), 3: ("updated", None), 4: ("new", None), 5: ("new", "s5"), 6: ("new", "s5-k6")}
    after = merge.refreshed(target, batch, "key", "position", "content", ("title",)).first()
    assert (after["content"], after["slug"]) == ("d", "s1") and tuple(merge.tallies(merge.adopt(target, batch)).first()) == (6, 4, 2, 2)


@pytest.mark.parametrize(("given", "want"), [(" A.B+c@Mail.Example ", "a.b+c@mail.example"), ("a@b", None), ("a..b@c.de", None), ("x" * 250 + "@c.de", None), ("", None), (None, None)])
def test_email(spark, given, want):
    assert one(spark, given, text.email) == want


def test_upsert_keeps_values(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    batch = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, name string, n int")
    got = {tuple(r) for r in merge.coalescing_upsert(target, batch, "k", ("n",), ("name",)).select("k", "name", "n").collect()}
    assert got == {(1, "a", 1), (2, "b", 9), (3, "c", 3)}


def test_nearest_day(spark):
    day = datetime.date
    probes = spark.createDataFrame([(day(2024, 1, 5),), (day(2024, 3, 1),), (day(2023, 1, 1),)], "p date")
    days = spark.createDataFrame([(day(2024, 1, 3),), (day(2024, 1, 7),), (day(2024, 2, 20),)], "d date")
    got = {r["p"]: r["nearest"] for r in asof.nearest_day(probes, days, "p", "d").collect()}
    assert got == {day(2024, 1, 5): day(2024, 1, 3), day(2024, 3, 1): day(2024, 2, 20), day(2023, 1, 1): day(2024, 1, 3)}


def test_rules_cap_errors(spark):
    pairs = spark.createDataFrame([("; ".join(str(n) for n in range(100, 140)), "t", "d", "x", 3)], "body string, title string, dek string, original string, source_length int")
    r = rules.judge(pairs, (("numeros", lambda: F.transform(editorial.content_numbers(F.col("body")), lambda n: F.concat(F.lit("number "), n))),)).first()
    assert not r["passed"] and "numeros" in r["failed_rules"] and len(r["errors"]) == 21 and r["errors"][-1]== "(+20 erro(s) omitido(s))"


def test_streaks(spark):
    runs = [("a", k, bad) for k, bad in enumerate([True, True, False, True, True, True])] + [("b", 0, False), (None, 1, True), ("c", 1, None), ("c", 2, True)]
    rng = random.Random(1)
    runs += [("d", k, rng.random() < 0.7) for k in range(200)]
    df = spark.createDataFrame(runs, "s string, t int, bad boolean")
    want = {}
    for s in {r[0] for r in runs}:
        best = now = 0
        for _, _, bad in sorted(r for r in runs if r[0] == s):
            now = now + 1 if bad else 0
            best = max(best, now)
        if best:
            want[s] = (best, best >= 3)
    for slot in (F.lit(0), F.col("t"), F.floor(F.col("t") / 3), F.floor(F.col("t") / 50)):
        assert {r[0]: (r[1], r[2]) for r in queue.failure_streaks(df, "s", "bad", ("t",), slot=slot).collect()} == want


def test_hot_keys_are_split(spark, monkeypatch):
    batch = spark.createDataFrame([("hot", k) for k in range(500)] + [("cold", 1), (None, 2)], "key string, pos int")
    target = spark.createDataFrame([("cold",)], "key string")
    monkeypatch.setattr("tessera.operators.skew.HOT_LEAST", 2)
    got = collections.Counter((r["key"], r["outcome"]) for r in merge.classify_batch(target, batch, "key", "pos").collect())
    assert got == {("hot", "new"): 1, ("hot", "duplicate"): 499, ("cold", "duplicate"): 1, (None, "new"): 1}


def test_pages_cover_all(spark):
    rows = spark.createDataFrame([(k, f"doc-{k}", "t", 5, "published", "en") for k in range(25)], "doc_id long, slug string, title string, published_at long, status string, category_slug string")
    seen = [r["doc_id"] for n in (1, 2, 3) for r in reads.category_page(rows, None, n, 10).collect()]
    assert sorted(seen) == list(range(25)) and reads.category_page(rows, None, 99, 10).first()["page"] == 3
    assert reads.category_page(rows.limit(0), None, 1).count() == 0


def test_stream_merges_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, pos int")
    df.write.parquet(source)
    for run in ("one", "two"):
        merge_stream(spark.readStream.schema(df.schema).parquet(source), target, str(tmp_path / run), "key", "pos").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target).select("key", "pos").collect()) == [("a", 1), ("b", 3)]
