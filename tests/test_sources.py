"""Sources: XML files both ways, pages by host in batch and as a stream, the registry's flags."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.sources import pages, registry, rss


def test_feed_files_both_ways(spark, tmp_path):
    """Every field comes back, signs and accents too; broken items stay apart wherever they stand, in one file or many."""
    rows = [("2026", "https://a.example/x?a=1&b=2", ("g-1", "false"), "á < b & \"c\"", "<p>Corpo</p>", ["Synod 10", "0 Caritas 1"], "Ana"), ("só título", None, None, None, None, [], None), (None, None, ("g-3", None), "  ", None, None, None)]
    schema = "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, description string, `content:encoded` string, category array<string>, `dc:creator` string"
    path = str(tmp_path / "feed")
    rss.write_items(spark.createDataFrame(rows, schema).repartition(2), path)
    spark.createDataFrame([("<channel><item><title>x</titel></item>",), ("<item><title>ok</title><category>1</category></item>",), ("<item><link>&nope;</link></item></channel>",)], "v string").coalesce(1).write.mode("append").text(path)
    found, broken = rss.read_items(spark, path)
    got = {r["title"]: r for r in found.collect()}
    assert set(got) == {"2026", "só título", "ok", None} and broken.count() == 2
    r = got["2026"]
    assert (r["link"], r["guid"], r["permalink"], r["description"], r["content"], r["categories"], r["author"]) == ("https://a.example/x?a=1&b=2", "g-1", False, "á < b & \"c\"", "<p>Corpo</p>", ["Synod 10", "0 Caritas 1"], "Ana")
    assert got[None]["guid"] == "g-3" and got[None]["permalink"] and got["ok"]["categories"] == ["1"]


def test_items_are_judged_in_one_pass(spark):
    good = "<rss><channel><item><title>t</title><link>https://a.example/1</link></item><item><title> </title><link>https://a.example/2</link></item></channel></rss>"
    df = spark.createDataFrame([(1, good), (2, "<html/>"), (3, None), (4, "<rss><channel><title>x</title></channel></rss>")], "k long, xml string")
    made = rss.judged_items(df)
    assert sorted((r["k"], r["position"], r["reason"]) for r in made.select("k", F.coalesce("position", F.lit(-1)).alias("position"), F.coalesce("reason", F.lit("")).alias("reason")).collect()) == [(1, 0, ""), (1, 1, "no address or title"), (2, -1, "no channel"), (3, -1, "no channel")]
    plan = made._jdf.queryExecution().optimizedPlan()
    assert sum("from_xml" in line for line in plan.toString().split("\n")) == 1


@pytest.fixture
def stored(tmp_path):
    rows = {"page_id": list(range(30)), "url": [f"https://H{k % 7}.example/{k}" if k % 5 else None for k in range(30)], "html": [f"<p>{k}</p>" if k % 4 else None for k in range(30)]}
    path = str(tmp_path / "pages.parquet")
    pq.write_table(pa.table(rows), path, row_group_size=4)
    return path, rows


def test_pages_by_host(spark, stored):
    path, rows = stored
    pages.register(spark)
    df = spark.read.format("portal_pages").option("path", path).option("groups", 3).load()
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["page_id"], r["url"], r["html"], r["host"]) for r in got) == sorted(zip(rows["page_id"], rows["url"], rows["html"], [pages.host_of(u) for u in rows["url"]]))
    tasks = {}
    for r in got:
        tasks.setdefault(r["host"], set()).add(r["task"])
    assert df.rdd.getNumPartitions() == 3 and all(len(t) == 1 for t in tasks.values())
    with pytest.raises(Exception, match="groups"):
        spark.read.format("portal_pages").option("path", path).option("groups", 0).load().count()


def test_pages_as_a_stream(spark, stored, tmp_path):
    """Seven pages a batch; after a restart from the checkpoint nothing comes twice."""
    path, rows = stored
    pages.register(spark)
    seen = []
    for _ in range(2):
        stream = spark.readStream.format("portal_pages").option("path", path).option("batch", 7).load()
        q = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted(r["page_id"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "log")).start()
        q.processAllAvailable()
        q.stop()
    assert [b for b in seen if b] == [list(range(a, min(a + 7, 30))) for a in range(0, 30, 7)]


def test_registry(spark):
    one = lambda name: lambda items, now: items.select(F.lit(name).alias("source"), now.alias("at"))
    made = registry.Registry((registry.Source("a", "A", one("a"), enrich=lambda rows, p: rows.withColumn("k", F.col("k") + 1)), registry.Source("b", "B", one("b"), on=False)))
    items = spark.range(2)
    names = lambda: sorted(r["source"] for r in made.collect(items, F.lit(5)).distinct().collect())
    assert names() == ["a"] and made.enrich(spark.range(1).withColumn("k", F.lit(1)), items).first()["k"] == 2
    try:
        spark.conf.set("tessera.source.b.enabled", "TRUE")
        assert names() == ["a", "b"]
        spark.conf.set("tessera.source.a.enabled", "false")
        assert names() == ["b"]
        spark.conf.set("tessera.source.b.enabled", "yes")
        with pytest.raises(ValueError, match="source.b"):
            made.enabled(spark)
    finally:
        for name in ("a", "b"):
            spark.conf.unset(f"tessera.source.{name}.enabled")
    with pytest.raises(ValueError, match="different"):
        registry.Registry((registry.Source("a", "A", one("a")),) * 2)
