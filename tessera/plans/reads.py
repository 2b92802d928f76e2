"""The read side: recency top-k, pages, search, related articles, highlights, navigation."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import CATEGORIES


def recent() -> tuple[Column, Column]:
    """Newest first; ids break ties."""
    return F.desc("published_at"), F.desc("doc_id")


def published(articles: DataFrame) -> DataFrame:
    return articles.filter("status = 'published'")


def latest(articles: DataFrame, k: int = 30, category: str | None = None) -> DataFrame:
    rows = published(articles)
    return (rows.filter(F.col("category_slug") == category) if category else rows).orderBy(*recent()).limit(k)


def category_page(articles: DataFrame, category: str | None, number: int, size: int = 12) -> DataFrame:
    """A page of at most 48 rows with page, pages and total; numbers outside the range are clamped."""
    rows = published(articles)
    rows = rows.filter(F.col("category_slug") == category) if category else rows
    size = min(max(size, 1), 48)
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    cut = rows.orderBy(*recent()).offset((number - 1) * size).limit(size)
    return cut.select("doc_id", "slug", "title", "published_at", F.lit(number).alias("page"), F.lit(pages).alias("pages"), F.lit(total).alias("total"))


def valid_pages(articles: DataFrame, requests: DataFrame, category: str = "category", number: str = "number", size: int = 12) -> DataFrame:
    """requests with pages and valid: whether the category (null: all) has the page; the first one is always there, others aren't found beyond the last."""
    rows = published(articles)
    by = rows.groupBy(F.col("category_slug").alias("__c")).agg(F.count(F.lit(1)).alias("n")).filter("__c is not null")  # a row a category
    every = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("__c"), "n")
    met = requests.join(F.broadcast(by.unionByName(every)), F.col(category).eqNullSafe(F.col("__c")), "left")
    pages = F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / F.lit(size)), F.lit(1)).cast("long")
    return met.select(*requests.columns, pages.alias("pages")).withColumn("valid", (F.col(number) == 1) | F.col(number).between(1, F.col("pages")))


def by_slug(articles: DataFrame, slug: str) -> DataFrame:
    return articles.filter((F.col("slug") == slug)).limit(1)


def related(articles: DataFrame, slug: str, category: str, k: int = 3) -> DataFrame:
    """Articles of the category first, then the most recent others."""
    rows = published(articles).filter(F.col("slug") != slug).withColumn("same_category", (F.col("category_slug") == category).cast("int"))
    return rows.orderBy(F.desc("same_category"), *recent()).limit(k)


def highlights(articles: DataFrame, now: int, k: int = 4, days: int = 7) -> DataFrame:
    """The last days' top k with their rank, or all time's where those days have none."""
    rows = published(articles)
    week = rows.filter(F.col("published_at") >= now - days * 86400).orderBy(*recent()).limit(k).withColumn("tier", F.lit(1))
    ever = rows.orderBy(*recent()).limit(k).withColumn("tier", F.lit(2))
    both = week.unionByName(ever)  # at most 2 k rows from here on
    best = F.min("tier").over(Window.partitionBy())
    top = both.withColumn("best", best).filter("tier = best")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(*recent()))).select("rank", "doc_id", "slug", "published_at", "tier")


def search(articles: DataFrame, term: str, k: int = 40) -> DataFrame:
    """Articles whose title or excerpt holds the term literally; terms under two characters find nothing."""
    term = term.strip().lower()
    rows = published(articles)
    hit = F.contains(F.lower("title"), F.lit(term)) | F.contains(F.lower("source_excerpt"), F.lit(term))
    return rows.filter(hit if len(term) >= 2 else F.lit(False)).orderBy(*recent()).limit(k)


def categories(spark: SparkSession) -> DataFrame:
    """11 rows."""
    return spark.createDataFrame([(*c, k) for k, c in enumerate(CATEGORIES)], "slug string, label string, in_nav boolean, in_chips boolean, place int")


def navigation(articles: DataFrame, names: DataFrame) -> DataFrame:
    """names (slug, ...) that have published articles."""
    return names.join(published(articles).select(F.col("category_slug").alias("slug")).distinct(), "slug", "left_semi")


def last_updates(articles: DataFrame, names: DataFrame) -> DataFrame:
    """Each name's last publication, 0 without any."""
    last = published(articles).groupBy(F.col("category_slug").alias("slug")).agg(F.max("published_at").alias("last"))
    return names.join(last, "slug", "left").select("slug", F.coalesce("last", F.lit(0)).alias("last"))


def shown_topics(articles: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """Published articles of the topics (all of them without any) with how many there are."""
    rows = published(articles)
    rows = rows.filter(F.col("category_slug").isin(list(topics))) if topics else rows
    return rows.withColumn("visible", F.lit(rows.count()))


def lead_and_rest(rows: DataFrame, k: int = 30) -> DataFrame:
    """The newest k with their part: the first is the lead, the next two are beside it, the rest follows."""
    cut = rows.orderBy(*recent()).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*recent())))
    return cut.withColumn("part", F.when(F.col("rank") == 1, "lead").when(F.col("rank") <= 3, "side").otherwise("rest"))


def page_window(current: Column, total: Column, around: int = 1) -> Column:
    """Page numbers to show: all up to seven, else the first, the last and those around the current one, with null for each gap."""
    near = F.filter(F.sequence(current - around, current + around), lambda p: (p >= 1) & (p <= total))
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), total), near)))
    gaps = F.flatten(F.transform(shown, lambda p, i: F.when((i > 0) & (p - F.get(shown, i - 1) > 1), F.array(F.lit(None).cast("int"), p)).otherwise(F.array(p))))
    return F.when(total <= 7, F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).otherwise(gaps)


def flagged_categories(articles: DataFrame, flag: int) -> DataFrame:
    """(slug, label, position): categories that have published articles and the flag (2: navigation, 3: chips), in display order."""
    names = articles.sparkSession.createDataFrame([(c[0], c[1], k) for k, c in enumerate(CATEGORIES) if c[flag]], "slug string, label string, position int")
    return F.broadcast(names).join(published(articles).select(F.col("category_slug").alias("slug")).distinct(), "slug", "left_semi")


def glossary(terms: DataFrame, entries: dict[str, str], term: str = "term") -> DataFrame:
    """terms with translation: that of the entry with the same English term in any letter case; null for unknown ones."""
    names = terms.sparkSession.createDataFrame([(k.lower(), v) for k, v in entries.items()], "__term string, translation string")
    return terms.join(F.broadcast(names), F.lower(F.trim(term)) == F.col("__term"), "left").drop("__term")


def refresh_list(articles: DataFrame, since: int, published_count: int) -> DataFrame:
    """Slugs and categories of what a run published, twice as many as it says at most, newest first."""
    rows = published(articles).filter(F.col("updated_at") >= since)
    return rows.orderBy(F.desc("updated_at"), F.desc("doc_id")).limit(2 * published_count).select("slug", "category_slug")
