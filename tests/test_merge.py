"""Slugs and merges against rows taken one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import slug_cut, with_suffix
from tessera.operators import merge


def cut(s, most):
    if len(s) <= most:
        return s
    head = s[:most]
    at = head.rfind("-")
    return (head[:at] if at > most * 0.5 else head).rstrip("-")


def suffixed(base, suffix):
    return f"{cut(base or '', 80 - len(suffix) - 1) or 'noticia'}-{suffix}"


def one_by_one(rows, taken):
    """rows: (position, slug, suffix, present or None)."""
    used, out = set(taken) | {p for *_, p in rows if p}, {}
    for at, slug, suffix, present in sorted(rows):
        out[at] = None
        for wish in [*([slug] if slug else []), suffixed(slug, suffix), *([present] if present else [])]:
            if wish not in used or wish == present:
                out[at] = wish
                used.add(wish)
                break
    return out


def test_slug_lengths(spark):
    rng = random.Random(3)
    words = ["-".join("".join(rng.choice("abc") for _ in range(rng.choice((1, 3, 12, 41)))) for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["a" * 40 + "-" + "b" * 60, "a" * 41 + "-" + "b" * 60, "a" * 36 + "-" + "b" * 60, "a" * 37 + "-" + "b" * 60, "", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", slug_cut(F.col("w"), 80).alias("c"), with_suffix(F.col("w"), F.lit("0123456789")).alias("s")).collect()
    assert all(r["c"] == cut(r["w"], 80) and r["s"] == suffixed(r["w"], "012345") and len(r["s"]) <= 80 for r in got)


@pytest.mark.parametrize("present", [False, True])
def test_free_slugs_as_one_by_one(spark, monkeypatch, present):
    """Chains in which a row's second wish is another's first, equal suffixes, taken slugs, long and empty ones, present slugs that others ask for."""
    monkeypatch.setattr("tessera.operators.skew.HOT_LEAST", 2)
    rng = random.Random(7)
    names = ["a", "b", "a-s1", "b-s1", "a-s1-s2", "a-s2", "p3", "p5", "", None, "x" * 80, "x" * 73 + "-s1", "x" * 73]
    rows = [(k, rng.choice(names), rng.choice(["s1", "s2"]), f"p{k}" if present else None) for k in range(60)]
    taken = ["b", "a-s2", "noticia-s2"]
    df = spark.createDataFrame(rows, "position long, slug string, suffix string, own string").repartition(3)
    got = merge.free_slugs(df, spark.createDataFrame([(t,) for t in taken], "slug string"), "slug", "position", "suffix", present="own" if present else None)
    assert {r["position"]: r["final_slug"] for r in got.collect()} == one_by_one(rows, taken)


def test_adoption_with_hot_keys(spark, monkeypatch):
    """Keys and slugs that most rows share; new rows' slugs as one by one."""
    monkeypatch.setattr("tessera.operators.skew.HOT_LEAST", 2)
    target = [("k0", "s0", "c", "a", "t0"), ("k1", "s1", "c", "a", "t1")]
    batch = [(f"n{k:05d}", "s0" if k % 2 else "new", "c", "a", "t0" if k == 5 else f"t{k}", k) for k in range(40)] + [("k0", "s0", "c", "a", "t0", 100)] * 1 + [("k1", "s1", "other", "a", "t1", 101 + k) for k in range(20)]
    names = "key string, slug string, content string, source string, title string"
    got = {r["position"]: (r["outcome"], r["final_slug"]) for r in merge.adopt(spark.createDataFrame(target, names), spark.createDataFrame(batch, names + ", position long")).collect()}
    fresh = one_by_one([(k, slug, key[:6], None) for key, slug, _, _, _, k in batch if k < 40 and k != 5], ["s0", "s1"])
    assert got == {k: ("new", s) for k, s in fresh.items()} | {5: ("adopted", "s0"), 100: ("duplicate", None)} | {101 + k: ("updated", None) for k in range(20)}


def test_keys_with_one_beginning(spark):
    """The later of two new rows whose keys share six characters has no slug, but the one that it asked for last is told."""
    names = "key string, slug string, content string, source string, title string"
    batch = [("abcdef1", "", "c", "a", "t1", 1), ("abcdef2", None, "c", "a", "t2", 2), ("abcdef3", "s", "c", "a", "t3", 3), ("abcdef4", "s", "c", "a", "t4", 4)]
    rows = merge.adopt(spark.createDataFrame([], names), spark.createDataFrame(batch, names + ", position long")).collect()
    assert {r["position"]: (r["final_slug"], r["asked_slug"]) for r in rows} == {1: ("noticia-abcdef",) * 2, 2: (None, "noticia-abcdef"), 3: ("s", "s"), 4: ("s-abcdef",) * 2}


def test_ingest_merge_where_digests_meet(spark, tmp_path):
    """Documents 21875 and 46115 have the same first six characters of their key's digest."""
    docs = [(i, "t") for i in (21875, 46115, 3, 4, 5, 8, 11)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next(tmp_path.glob("parts/*.parquet")).rename(tmp_path / "documents.parquet")
    from tessera.queries import ORACLE_SQL, QUERIES

    from .oracle import connect, differences

    assert (d := differences(QUERIES["ingest_merge"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL["ingest_merge"])) is None, d


def test_refreshed_takes_the_first_of_many(spark):
    target = spark.createDataFrame([("a", 1, "x"), (None, 1, "y"), ("b", 1, "z")], "k string, c int, t string")
    batch = spark.createDataFrame([("a", 2, "later", 9), ("a", 3, "first", 1), (None, 5, "null", 4), ("b", 1, "same", 2)] * 3, "k string, c int, t string, at int")
    assert {tuple(r) for r in merge.refreshed(target, batch, "k", "at", "c", ("t",)).collect()} == {("a", 3, "first"), (None, 5, "null"), ("b", 1, "z")}


def test_first_rows(spark):
    """Of keys with many rows the first, equal ones once, null keys as one; as classify_batch tells new ones."""
    rows = [(k % 3 if k % 4 else None, k // 6, f"v{k % 2}") for k in range(60)] * 2
    df = spark.createDataFrame(rows, "k long, at long, v string").repartition(5)
    got = sorted(map(tuple, merge.first_rows(df, "k", "at").collect()), key=repr)
    new = merge.classify_batch(df.limit(0), df, "k", "at").filter("outcome = 'new'").drop("outcome").distinct()
    assert got == sorted(map(tuple, new.collect()), key=repr) and len(got) == 4


def test_merged_batches_have_a_file_a_folder(spark, tmp_path):
    from tessera.streaming import ingest

    spark.range(2000).select("id", F.timestamp_seconds("id").alias("ts")).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ingest.merge_stream(stream, f"{tmp_path}/table", f"{tmp_path}/log", "id", "ts").awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    table = spark.read.parquet(f"{tmp_path}/table")
    assert table.count() == 2000 and len(table.inputFiles()) == ingest.BUCKETS
