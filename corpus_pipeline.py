"""Corpus pipeline: language ID, near duplicates, secrets, source mixing, BPE ids.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on; run() writes each stage's
documents as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_documents
from tessera.llm.common import crc_mod, table, written
from tessera.llm.jaccard import jaccard_components
from tessera.llm.langid import UNDETERMINED, fit, predict_language
from tessera.llm.mixing import poisson_replicate
from tessera.llm.queries import WEIGHTS, vocabulary
from tessera.llm.secrets import redact_secrets
from tessera.operators.skew import split_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of the predicted language with which a document stays.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with LEAST_SCORE or more stay; those without a letter or with a mix go. Columns as before."""
    net = fit(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    told = predict_language(docs, net, keep=("text", "lang", "source", "n_chars"))
    return told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays, once: the one with the smallest id (null last), then the smallest md5 of its text. Documents without words stay."""
    groups = written(jaccard_components(docs.select("doc_id", "text"), words=5, percent=80, keys=True), "groups")
    ident = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")
    least = groups.filter("n_shingles > 0").groupBy("component_key").agg(F.min(ident).alias("kept"), F.count(F.lit(1)).alias("n"))
    total = docs.count()
    marked = split_join(groups.filter("n_shingles > 0"), least, ["component_key"], "n", total)
    gone = marked.filter(~F.col("kept").eqNullSafe(ident)).select(F.col("doc_id").alias("__id"), "text_md5").distinct()
    keyed = docs.select(*COLUMNS).withColumn("__md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("text_md5")), "left_anti")
    repeats = groups.filter("n_shingles > 0").groupBy("doc_id", "text_md5").count().filter("count > 1")
    if repeats.limit(1).count():  # the same id and text in several rows: one stays
        words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        left = left.filter(words).dropDuplicates(["doc_id", "__md5"]).unionByName(left.filter(~words))
    return left.select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; reported secrets are replaced in its text, and n_chars follows."""
    return redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights and shuffled; copies are rows alike."""
    return poisson_replicate(docs, WEIGHTS).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): each document's ids; copies stay."""
    return encode_documents(docs, vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]
#: A trained network and BPE can't be expressed in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
