"""Glossary blocks and terms against plain Python; the run log of streams."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import upper_each
from tessera.plans import glossary
from tessera.streaming import runlog

SCHEMA = "term string, translation string, kind string, note string, place long"
ENTRIES = [("Holy See", "Santa Sé", "instituicao", None, 1), ("Roman Curia", "Cúria Romana", "instituicao", "nunca a curia", 2), ("Holy Father", "Santo Padre", "titulo", None, 3), ("Lent", "Quaresma", "doutrina", None, 5), ("Bishop", "Bispo", "titulo", None, 4)]


def test_blocks(spark):
    df = spark.createDataFrame(ENTRIES, SCHEMA).repartition(3)
    assert glossary.prompt(df).first()["text"] == "[instituicao]\n  Holy See = Santa Sé\n  Roman Curia = Cúria Romana  (nunca a curia)\n[titulo]\n  Holy Father = Santo Padre\n  Bishop = Bispo"
    assert glossary.prompt(df, ("doutrina", "santo")).first()["text"] == "[doutrina]\n  Lent = Quaresma"
    got = glossary.looked_up(spark.createDataFrame([(" holy SEE ",), ("See",), (None,)], "term string"), df)
    assert {r["term"]: r["translation"] for r in got.collect()} == {" holy SEE ": "Santa Sé", "See": None, None: None}


def test_capitals_letter_by_letter(spark):
    """As DuckDB's upper: no letter becomes two."""
    words = ["erßie", "ŉa", "straße ᾳ", "ﬁx ΐ", "são", "a𐐨b", "", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", upper_each(F.col("w")).alias("u")).collect()
    assert {r["w"]: r["u"] for r in got} == {w: duckdb.execute("select upper(?::varchar)", [w]).fetchone()[0] for w in words}


def plain(text, terms):
    words, out, k = re.findall(r"[^\W_]+", (text or "").lower()), [], 0
    while k < len(words):
        fits = [t for t in terms if words[k : k + len(t)] == list(t)]
        if fits:
            best = max(fits, key=len)
            out.append((k, len(best), terms[best]))
            k += len(best)
        else:
            k += 1
    return out


def test_terms_longest_first(spark):
    """Overlaps, terms inside others, repeated terms, signs between words, letters without case, nulls and long texts."""
    rng = random.Random(4)
    entries = ["A", "a b", "A B C", "b c d", "C", "d-d", "Ação É", "x1", "c d d", "A b", "!"]
    table = spark.createDataFrame([(t, t, "titulo", None, k) for k, t in enumerate(entries)], SCHEMA)
    terms = {}
    for t in entries:
        w = tuple(re.findall(r"[^\W_]+", t.lower()))
        if w:
            terms.setdefault(w, t)
    texts = [(k, rng.choice([" ", "-", ", "]).join(rng.choice(["a", "B", "c", "d", "e", "ação", "É", "x1"]) for _ in range(rng.randrange(30)))) for k in range(120)] + [(500, None), (501, ""), (502, "a b " * 3000)]
    got = {}
    for r in glossary.met(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), table).collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["n_words"], r["term"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, t in texts if (w := plain(t, terms))}


def test_terms_without_a_row_a_word(spark, monkeypatch):
    """Words are not dealt out: no row a word, no shuffle of the texts. The same terms whatever a task looks at together, also for repeated keys and an empty glossary."""
    monkeypatch.setattr(glossary, "PART_WORDS", 7, raising=False)
    rng = random.Random(9)
    entries = ["a", "a b", "b a b", "a b c d", "d a"]
    table = spark.createDataFrame([(t, t, "titulo", None, k) for k, t in enumerate(entries)], SCHEMA)
    texts = [(k // 2, " ".join(rng.choice("aAbBcd") for _ in range(rng.randrange(12)))) for k in range(80)] + [(90, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    got = glossary.met(df, table)
    assert not {"Generate", "Exchange"} & set(re.findall(r"\w+", got._jdf.queryExecution().executedPlan().toString()))
    terms = {tuple(t.split()): t for t in entries}
    assert sorted((r["doc_id"], r["position"], r["n_words"], r["term"]) for r in got.collect()) == sorted((k, *x) for k, t in texts for x in plain(t, terms))
    assert glossary.met(df, table.limit(0)).count() == 0


def test_glossary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(glossary, "MOST", 3)
    with pytest.raises(ValueError, match="at most"):
        glossary.met(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame(ENTRIES, SCHEMA))


def test_run_log_from_the_listener(spark, tmp_path):
    """A run's batches, rows and observed counts; a run that fails is logged as crashed with its reason."""
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = runlog.RunLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        def start(name, column):
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("seen", F.count_if(F.col("id") % 2 == 0).alias("even"), F.count(F.lit(1)).alias("all"))
            return stream.withColumn("v", column).writeStream.queryName(name).format("parquet").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start(str(tmp_path / f"o-{name}"))

        start("fine", F.col("id")).awaitTermination()
        with pytest.raises(Exception):  # noqa: B017, PT011
            start("broken", F.assert_true(F.col("id") < 0)).awaitTermination()
        assert runlog.wait_for(log, 2)
    finally:
        spark.streams.removeListener(log)
    rows = {r["query"]: r for r in log.rows().collect()}
    fine, broken = rows["fine"], rows["broken"]
    assert (fine["batches"], fine["rows_in"], fine["seen"], fine["crashed"]) == (3, 30, {"seen.even": 15, "seen.all": 30}, False)
    assert broken["crashed"] and broken["error"] and broken["rows_in"] == 0
