"""Tables and the article view over them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of the article view.
NOW = 1706659200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: labels decide the status, the id the instant of publication."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality").isNull(), "draft").when((F.col("quality") == 1) & (F.col("toxic") == 0), "published").otherwise("failed_validation")
    return d.join(marks, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("source_excerpt"),
        F.col("n_chars").alias("source_length"), F.col("lang").alias("category_slug"), "source", (F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).alias("published_at"), status.alias("status"),
    )


ARTICLES_SQL = """with articles_v as (select d.doc_id, concat('doc-', cast(d.doc_id as varchar)) slug, split_part(d.text, '.', 1) title, d.text source_excerpt,
 d.n_chars source_length, d.lang category_slug, d.source source, 1704067200 + (d.doc_id * 7919) % 2592000 published_at,
 case when l.doc_id is null then 'draft' when l.quality = 1 and l.toxic = 0 then 'published' else 'failed_validation' end status
 from documents d left join labels l on d.doc_id = l.doc_id), pub as (select * from articles_v where status = 'published') """


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles with the columns that exports, rules and merges read; values follow from id and text."""
    a, i = articles(spark, sf_dir), F.col("doc_id")
    category = F.create_map(*(F.lit(x) for pair in STORY_CATEGORY.items() for x in pair))
    return a.withColumn("category_slug", F.coalesce(category[F.col("category_slug")], F.lit("mundo"))).withColumns({
        "source_title": F.col("title"), "dek": F.when(i % 4 != 0, F.substring("source_excerpt", 1, 230)), "image_url": F.when(i % 3 == 0, F.concat(F.lit("https://img.example/"), i.cast("string"), F.lit(".jpg"))),
        "source_author": F.when(i % 5 == 0, F.lit("A. Author")), "source_name": F.coalesce("source", F.lit("")), "source_url": F.concat(F.lit("https://news.example/a&b/"), F.col("slug")), "tags": F.array(F.lit("igreja"), F.coalesce("source", F.lit(""))),
        "updated_at": F.col("published_at") + i % 1000, "fetched_at": F.col("published_at") + 600,
    }).withColumn("title", F.when(i % 7 == 0, F.lit("  ")).otherwise(F.col("title")))


STORY_CATEGORY = {"en": "vaticano", "de": "liturgia", "fr": "santos"}
STORIES_SQL = ARTICLES_SQL.rstrip().removesuffix(", pub as (select * from articles_v where status = 'published')") + """,
stories as (select * exclude (title, category_slug), title source_title, case when doc_id % 7 = 0 then '  ' else title end title,
 case category_slug when 'en' then 'vaticano' when 'de' then 'liturgia' when 'fr' then 'santos' else 'mundo' end category_slug, case when doc_id % 4 <> 0 then left(source_excerpt, 230) end dek,
 case when doc_id % 3 = 0 then concat('https://img.example/', doc_id, '.jpg') end image_url, case when doc_id % 5 = 0 then 'A. Author' end source_author, coalesce(source, '') source_name,
 concat('https://news.example/a&b/', slug) source_url, published_at + doc_id % 1000 updated_at, published_at + 600 fetched_at from articles_v), pub as (select * from stories where status = 'published') """
