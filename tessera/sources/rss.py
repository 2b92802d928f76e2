"""RSS 2.0 feeds in a column of documents; the schema is declared, so that a headline '2026' stays a string."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.dates import rfc822_seconds
from ..functions.html import clean_text
from ..functions.text import shorten
from ..functions.url import canonical
from ..plans.classify import category
from .shared import kept


def _struct(**fields: object) -> StructType:
    return StructType([StructField(name.replace("__", ":"), kind or StringType()) for name, kind in fields.items()])


MEDIA = _struct(_url=None, _width=None, _height=None, media__description=None, media__credit=None)
ITEM = _struct(
    title=None, link=None, guid=_struct(_VALUE=None, _isPermaLink=None), description=None, content__encoded=None, pubDate=None, dc__creator=None, author=None, category=ArrayType(StringType()),
    enclosure=_struct(_url=None), media__content=ArrayType(MEDIA),
)
SCHEMA = _struct(channel=_struct(title=None, item=ArrayType(ITEM)))
#: Column of what couldn't be read.
BROKEN = "_broken"
#: Characters of source text that are kept.
MATERIAL = 6_000


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _fields(rows: DataFrame, passed: list[str]) -> DataFrame:
    """rows with __item (see ITEM) as items."""
    i = F.col("__item")
    media = F.get(i["media:content"], F.lit(0))
    medium = F.struct(media["_url"].alias("url"), media["_width"].try_cast("int").alias("width"), media["_height"].try_cast("int").alias("height"), _filled(media["media:description"]).alias("description"), _filled(media["media:credit"]).alias("credit"))
    return rows.select(
        *passed, _filled(i["title"]).alias("title"), _filled(i["link"]).alias("link"), _filled(i["guid"]["_VALUE"]).alias("guid"), (F.coalesce(i["guid"]["_isPermaLink"], F.lit("true")) != "false").alias("permalink"),
        _filled(i["description"]).alias("description"), _filled(i["content:encoded"]).alias("content"), _filled(i["pubDate"]).alias("pub_date"), F.coalesce(_filled(i["dc:creator"]), _filled(i["author"])).alias("author"),
        F.filter(F.transform(F.coalesce(i["category"], F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "").alias("categories"), _filled(i["enclosure"]["_url"]).alias("enclosure_url"), F.when(media["_url"].isNotNull(), medium).alias("media"),
    )


def feed_items(feeds: DataFrame, xml_col: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(items, broken feeds): one row an item with position, title, link, guid, permalink, description, content, pub_date, author, categories, enclosure_url and media struct(url, width, height, description, credit).

    The first media:content with an address counts; a guid is a permalink unless it says no. A document without a channel is a broken feed. Other columns pass.
    """
    parsed = feeds.withColumn("__feed", F.from_xml(F.col(xml_col), SCHEMA))
    others = feeds.drop(xml_col).columns
    rows = parsed.filter("__feed.channel is not null").select(*others, F.posexplode("__feed.channel.item").alias("position", "__item"))
    return _fields(rows, [*others, "position"]), parsed.filter("__feed.channel is null").drop("__feed")


def judged_items(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Items of feeds with whole texts and reason: why an item or a whole feed ('no channel') is left out, null where it isn't. One pass over the feeds gives both."""
    others = feeds.drop(xml_col).columns
    parsed = feeds.withColumn("__feed", F.from_xml(F.col(xml_col), SCHEMA))
    whole = F.col("__feed.channel").isNotNull()
    rows = parsed.select(*others, whole.alias("__whole"), F.posexplode_outer("__feed.channel.item").alias("position", "__item"))
    rows = rows.filter(F.col("position").isNotNull() | ~F.col("__whole"))  # a channel without items has none to judge
    made = _fields(rows, [*others, "__whole", "position"])
    url = canonical(F.coalesce("link", F.when(F.col("permalink"), F.col("guid"))))
    reason = F.when(~F.col("__whole"), "no channel").when(url.isNull() | clean_text(F.col("title")).isNull(), "no address or title")
    return made.withColumn("reason", reason).drop("__whole")


def write_items(items: DataFrame, path: str) -> None:
    """Items with the fields of ITEM (those that are there) as XML files of a channel each."""
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").option("validateName", "false").mode("overwrite").save(path)  # names such as dc:creator


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, broken): items as feed_items gives them, of all XML files under path, and the text of each item that is no XML. The files are read once, in parts that Spark cuts them into."""
    schema = StructType([*ITEM.fields, StructField(BROKEN, StringType())])
    conf, name = spark.conf, "spark.sql.legacy.useLegacyXMLParser"
    before = conf.get(name, "false")
    conf.set(name, "true")  # reads item by item; the other parser gives up a file at its first broken item
    try:
        rows = kept(spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).schema(schema).load(path), "items")
    finally:
        conf.set(name, before)
    item = F.struct(*(F.col(f"`{f.name}`") for f in ITEM.fields)).alias("__item")
    return _fields(rows.select(BROKEN, item).filter(F.col(BROKEN).isNull()), []), rows.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("xml"))


def _normalised(items: DataFrame, source: str, source_name: str, url: Column, body: Column, now: Column, image: Column, credit: Column, caption: Column) -> tuple[DataFrame, DataFrame]:
    made = items.withColumn("__url", canonical(url)).withColumn("__title", clean_text(F.col("title"))).withColumn("__body", body)
    good = F.col("__url").isNotNull() & F.col("__title").isNotNull()
    rows = made.filter(good).select(
        F.lit(source).alias("source"), F.lit(source_name).alias("source_name"), F.col("__url").alias("url"), "guid", F.col("__title").alias("title"), shorten(F.col("__body"), MATERIAL).alias("excerpt"), "author",
        F.coalesce(F.length("__body"), F.lit(0)).cast("long").alias("source_length"), category(F.col("__url"), F.col("__title"), F.col("categories")).alias("category"), F.col("categories").alias("tags"), image.alias("image_url"), credit.alias("image_credit"),
        caption.alias("image_caption"), rfc822_seconds(F.col("pub_date"), now).alias("published_at"), "position",
    )
    return rows, made.filter(~good).drop("__url", "__title", "__body")


def full_text_items(items: DataFrame, source: str, source_name: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of a feed with whole texts: the link or a permalink is the address, the content or the description the body, media or enclosure the image. Rejects lack an address or a title."""
    url = F.coalesce("link", F.when(F.col("permalink"), F.col("guid")))
    body = F.coalesce(clean_text(F.col("content")), clean_text(F.col("description")))
    image = canonical(F.coalesce("media.url", "enclosure_url"))
    return _normalised(items, source, source_name, url, body, now, image, F.col("media.credit"), F.col("media.description"))


def excerpt_items(items: DataFrame, source: str, source_name: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of a feed with excerpts alone: only the link is trusted, no image yet."""
    none = F.lit(None).cast("string")
    return _normalised(items, source, source_name, F.col("link"), clean_text(F.col("description")), now, none, none, none)
