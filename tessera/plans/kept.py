"""Kept results with tags: counts and top lists that follow from a batch's changes alone.

A change is an article's row before and after a batch. Its signed deltas move the counts by status and category; its
tags name the lists to mend: one a category, and ``home`` for all. Lists that a batch doesn't touch are neither read nor
written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import kept

#: Rows of a list, and how many are stored of it, so that some may leave before it is read anew.
TOP, STORED = 30, 60
HOME, SLICES = "home", 64
COLUMNS = ("status", "category_slug", "slug", "published_at")
COUNTS, LISTS = "status string, category_slug string, n long", "doc_id long, slug string, published_at long, floor_at long, floor_id long"


def changes(before: DataFrame, batch: DataFrame) -> DataFrame:
    """(doc_id, old, new) of the batch's rows that are new or differ from the table's; old is null for new ones. Ids are unique in both."""
    state = lambda df: df.select("doc_id", F.struct(*COLUMNS).alias("s"))
    both = state(batch).withColumnRenamed("s", "new").join(state(before).withColumnRenamed("s", "old"), "doc_id", "left")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def merged(before: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the batch."""
    return before.join(batch.select("doc_id"), "doc_id", "left_anti").unionByName(batch)


def deltas(changed: DataFrame) -> DataFrame:
    """(status, category_slug, n): what the changes add to each count, without zeros."""
    sides = F.array(F.struct(F.col("old").alias("s"), F.lit(-1).cast("long").alias("n")), F.struct(F.col("new").alias("s"), F.lit(1).cast("long").alias("n")))
    rows = changed.select(F.explode(sides).alias("d")).filter("d.s is not null").select("d.s.status", "d.s.category_slug", "d.n")
    return rows.groupBy("status", "category_slug").agg(F.sum("n").alias("n")).filter("n <> 0")


def moved(counts: DataFrame, more: DataFrame) -> DataFrame:
    """counts after the deltas; a count of zero goes."""
    return counts.unionByName(more).groupBy("status", "category_slug").agg(F.sum("n").alias("n")).filter("n <> 0")


def tags_of(side: str) -> list[Column]:
    return [F.when(F.col(f"{side}.status") == "published", tag) for tag in (F.lit(HOME), F.col(f"{side}.category_slug"))]


def touched(changed: DataFrame) -> DataFrame:
    """(tag): the lists in which a published article comes, goes or changes."""
    return changed.select(F.explode(F.array_compact(F.array(*tags_of("old"), *tags_of("new")))).alias("tag")).distinct()


def entries(articles: DataFrame) -> DataFrame:
    """(tag, doc_id, slug, published_at) of every published article: one for home, one for its category."""
    return articles.filter("status = 'published'").select(F.explode(F.array_compact(F.array(F.lit(HOME), "category_slug"))).alias("tag"), "doc_id", "slug", "published_at")


def place(at: str = "published_at", key: str = "doc_id") -> Column:
    """What orders a list, the largest first."""
    return F.struct(F.col(at).alias("at"), F.col(key).alias("id"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The newest k entries of each tag with their rank. A tag may hold all articles, so each of SLICES slices of it is cut to k first."""
    def best(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("tag", *by).orderBy(place().desc()))).filter(F.col("rank") <= k)

    return best(best(rows.withColumn("__slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))), "__slice").drop("__slice", "rank"))


def cut(rows: DataFrame) -> DataFrame:
    """What is stored of lists (tag, doc_id, slug, published_at, floor_at, floor_id): the newest STORED entries, and the floor down to which a list is known (null: to its end); an empty list has a row without entry."""
    real = ranked(rows.filter("doc_id is not null"), STORED + 1)
    old = rows.groupBy("tag").agg(F.max(F.when(F.col("floor_id").isNotNull(), place("floor_at", "floor_id"))).alias("old"))
    last = real.groupBy("tag").agg(F.max_by(place(), F.when(F.col("rank") <= STORED, F.col("rank"))).alias("floor"), F.max("rank").alias("n"))
    floors = old.join(last, "tag", "left").withColumn("f", F.when(F.col("n") > STORED, F.col("floor")).otherwise(F.col("old"))).select("tag", "f.at", "f.id")
    kept = floors.join(real.filter(F.col("rank") <= STORED), "tag", "left")
    return kept.select("tag", "doc_id", "slug", "published_at", F.col("at").alias("floor_at"), F.col("id").alias("floor_id"))


class Kept:
    """The stored results: path/counts/version=<n> and path/lists/version=<n>/tag=<tag>, n being the batch that wrote them, from 0.

    A reader takes each tag's highest version; a batch that runs again replaces its own files. The driver reads tags of
    lists to be filled anew: as many as there are categories.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def counts(self, version: int) -> DataFrame:
        """(status, category_slug, n) after a batch."""
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/version={version}")

    def stored(self, version: int) -> DataFrame:
        """Each tag's rows as of a batch."""
        rows = self.spark.read.schema(f"{LISTS}, version int, tag string").option("basePath", f"{self.path}/lists").parquet(f"{self.path}/lists").filter(F.col("version") <= version)
        last = rows.groupBy("tag").agg(F.max("version").alias("version"))
        return rows.join(last, ["tag", "version"]).drop("version")

    def lists(self, version: int) -> DataFrame:
        """(tag, rank, doc_id, slug, published_at): the newest TOP articles of each tag after a batch."""
        return ranked(self.stored(version).filter("doc_id is not null").select("tag", "doc_id", "slug", "published_at"), TOP)

    def start(self, articles: DataFrame) -> None:
        """Version 0: everything counted once."""
        articles.groupBy("status", "category_slug").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/version=0")
        self._write(0, self._unknown(entries(articles)))

    def apply(self, version: int, changed: DataFrame, after: DataFrame) -> list[str]:
        """Brings the results from version - 1 to what the changes make of them, and returns the tags whose lists were read anew from ``after``, the table after the batch.

        A stored list is known down to its floor: what the changes leave and add above it stands, what they add below it may be behind
        articles that aren't stored. A list with fewer than TOP entries above its floor is read anew.
        """
        changed = kept(changed, "changes")  # read by every step below
        moved(self.counts(version - 1), deltas(changed)).write.mode("overwrite").parquet(f"{self.path}/counts/version={version}")
        tags = touched(changed)
        held = self.stored(version - 1).join(tags, "tag", "left_semi")
        floors = tags.join(held.groupBy("tag").agg(F.max("floor_at").alias("floor_at"), F.max("floor_id").alias("floor_id")), "tag", "left")
        new = entries(changed.filter("new.status = 'published'").select("doc_id", "new.*"))
        stay = held.filter("doc_id is not null").select("tag", "doc_id", "slug", "published_at").join(changed.select("doc_id"), "doc_id", "left_anti")
        above = floors.join(stay.unionByName(new), "tag", "left").filter(F.col("floor_id").isNull() | F.col("doc_id").isNull() | (place() >= place("floor_at", "floor_id")))
        above = kept(above, "lists")
        sizes = floors.join(above.groupBy("tag").agg(F.count("doc_id").alias("n")), "tag", "left")
        again = [r["tag"] for r in sizes.filter(F.col("floor_id").isNotNull() & (F.coalesce("n", F.lit(0)) < TOP)).select("tag").collect()]
        marks = floors.select("tag", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("long").alias("published_at"), "floor_at", "floor_id")
        made = above.select("tag", "doc_id", "slug", "published_at", "floor_at", "floor_id").unionByName(marks)
        if again:
            made = made.filter(~F.col("tag").isin(again)).unionByName(self._unknown(entries(after).filter(F.col("tag").isin(again))))
        self._write(version, made)
        return sorted(again)

    def _unknown(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", F.lit(None).cast("long").alias("floor_at"), F.lit(None).cast("long").alias("floor_id"))

    def _write(self, version: int, rows: DataFrame) -> None:
        cut(rows).write.partitionBy("tag").mode("overwrite").parquet(f"{self.path}/lists/version={version}")
