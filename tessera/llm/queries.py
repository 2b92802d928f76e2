"""Queries opN_<name> over the tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_documents, token_digests
from .centroids import cluster
from .centroids import oracle as cluster_sql
from .chunks import repeated_passages
from .codes import compress
from .codes import oracle as compress_sql
from .common import crc_mod, table
from .jaccard import jaccard_components
from .langid import fit, predict_language
from .licenses import scan_licenses
from .lm import score_documents
from .media import media_features, with_media
from .mixing import oracle as mixing_sql
from .mixing import poisson_replicate
from .quality import fit as fit_quality
from .quality import score_quality
from .secrets import scan_secrets

#: Target shares of the sources; those that are left out weigh 1.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5, "src3": 1.5}


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32 of the id mod 7 is not 2; a null id is not held out and not learned from."""
    rest = crc_mod(F.col("doc_id"), 7)
    out = score_documents(table(spark, sf_dir, "documents"), rest != 2)
    held_out = F.coalesce(rest == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, *out.columns[2:])


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_replicate(table(spark, sf_dir, "documents"), WEIGHTS)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The byte-level vocabulary of the public tokenizers package; the file is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted where crc32 of the id mod 5 is not 0; a null id is not held out and not learned from."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return predict_language(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32 of the id mod 3 is not 1; a null id is not held out and not learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_quality(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return score_quality(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_media": op2_media,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_nearest": op5_nearest,
    "op6_passages": op6_passages,
    "op7_bpe": op7_bpe,
    "op8_jaccard": op8_jaccard,
    "op9_language": op9_language,
    "op10_licenses": op10_licenses,
    "op11_clusters": op11_clusters,
    "op12_codes": op12_codes,
    "op13_quality": op13_quality,
}
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing_sql(WEIGHTS), "op11_clusters": cluster_sql(), "op12_codes": compress_sql()}
