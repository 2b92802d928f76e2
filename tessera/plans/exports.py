"""Exports as rows of text: feed, sitemaps, JSON-LD documents, page metadata. Columns are those of sources.tables.stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CATEGORIES, FIXED_PAGES
from ..functions.dates import iso, rfc822
from ..functions.text import brief, cdata_safe, xml_escape
from .classify import label
from .reads import published, recent

SITE, SITE_NAME, ABOUT = "https://portal.example", "Portal", "Notícias e documentos."
#: Characters of a headline and of a description.
HEADLINE, DESCRIPTION = 110, 200


def shown_title(title: Column, source_title: Column) -> Column:
    """The own title, trimmed, else the source's."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), source_title)


def description(dek: Column) -> Column:
    """The dek, cut; never the source's text."""
    return F.coalesce(F.nullif(brief(F.coalesce(dek, F.lit("")), DESCRIPTION), F.lit("")), F.lit(ABOUT))


def address(slug: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/noticia/"), slug)


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _tag(name: str, value: Column, indent: int = 6) -> Column:
    return F.concat(F.lit(f"{' ' * indent}<{name}>"), value, F.lit(f"</{name.split(' ')[0]}>"))


def rss_rows(articles: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, published_at, item): the newest k as RSS items; a null image leaves the enclosure out."""
    url, text = xml_escape(address(F.col("slug"))), F.concat(description(F.col("dek")), F.lit(" (Com base em reportagem de "), F.col("source_name"), F.lit(" — "), F.col("source_url"), F.lit(")"))
    item = _lines(
        "    <item>", _tag("title", xml_escape(shown_title(F.col("title"), F.col("source_title")))), _tag("link", url), F.concat(F.lit('      <guid isPermaLink="true">'), url, F.lit("</guid>")), _tag("pubDate", rfc822(F.col("published_at"))),
        _tag("category", xml_escape(label(F.col("category_slug")))), F.lit(f"      <dc:creator>Redação {SITE_NAME}</dc:creator>"), F.concat(F.lit("      <description><![CDATA["), cdata_safe(text), F.lit("]]></description>")),
        F.concat(F.lit('      <source url="'), xml_escape(F.col("source_url")), F.lit('">'), xml_escape(F.col("source_name")), F.lit("</source>")),
        F.concat(F.lit('      <enclosure url="'), xml_escape(F.col("image_url")), F.lit('" type="image/jpeg" />')), "    </item>",
    )
    return published(articles).orderBy(*recent()).limit(k).select("doc_id", "published_at", item.alias("item"))


def rss_document(articles: DataFrame, k: int = 50) -> DataFrame:
    """One row: the feed's document of at most k items, newest first."""
    rows = rss_rows(articles, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("published_at")).alias("a"), (-F.col("doc_id")).alias("b"), "item"))).alias("rows"))
    head = _lines(
        '<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/">', "  <channel>", f"    <title>{SITE_NAME}</title>", f"    <link>{SITE}</link>",
        f"    <description>{ABOUT}</description>", "    <language>pt-BR</language>", F.concat(F.lit("    <lastBuildDate>"), rfc822(-F.get("rows", F.lit(0))["a"]), F.lit("</lastBuildDate>")), "    <ttl>15</ttl>",
        f'    <atom:link href="{SITE}/feed.xml" rel="self" type="application/rss+xml" />',
    )
    return rows.select(F.size("rows").alias("n_items"), _lines(head, F.array_join(F.transform("rows", lambda r: r["item"]), "\n"), "  </channel>", "</rss>", "").alias("document"))


def news_sitemap(articles: DataFrame, now: int, hours: int = 48, k: int = 1000) -> DataFrame:
    """(doc_id, loc, published_at, entry): articles of the last hours, newest first, with their XML."""
    rows = published(articles).filter(F.col("published_at") >= now - hours * 3600).orderBy(*recent()).limit(k)
    entry = _lines(
        "  <url>", _tag("loc", xml_escape(address(F.col("slug"))), 4), "    <news:news>", "      <news:publication>", f"        <news:name>{SITE_NAME}</news:name>", "        <news:language>pt</news:language>", "      </news:publication>",
        _tag("news:publication_date", iso(F.col("published_at"))), _tag("news:title", xml_escape(shown_title(F.col("title"), F.col("source_title")))), "    </news:news>", "  </url>",
    )
    return rows.select("doc_id", address(F.col("slug")).alias("loc"), "published_at", entry.alias("entry"))


def sitemap(articles: DataFrame, k: int = 50_000) -> DataFrame:
    """(section, loc, updated_at, frequency, priority): home, archive, categories that have articles, fixed pages, the newest k articles."""
    spark = articles.sparkSession
    rows = published(articles).orderBy(*recent()).limit(k)
    newest = rows.agg(F.max_by("updated_at", F.struct("published_at", "doc_id")).alias("updated_at"))
    front = newest.select(F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(loc).alias("loc"), F.col("updated_at"), F.lit("hourly").alias("frequency"), F.lit(p).alias("priority")) for s, loc, p in ((0, SITE, 1.0), (1, f"{SITE}/noticias", 0.9))))).alias("r")).select("r.*")
    known = [c[0] for c in CATEGORIES]
    cats = rows.filter(F.col("category_slug").isin(known)).groupBy("category_slug").agg(F.max("updated_at").alias("updated_at"))
    cats = cats.select(F.lit(2).alias("section"), F.concat(F.lit(f"{SITE}/categoria/"), F.col("category_slug")).alias("loc"), "updated_at", F.lit("daily").alias("frequency"), F.lit(0.7).alias("priority"))
    fixed = spark.createDataFrame([(3, f"{SITE}/{p}", None, "yearly", 0.3) for p in FIXED_PAGES], "section int, loc string, updated_at long, frequency string, priority double")
    pages = rows.select(F.lit(4).alias("section"), address(F.col("slug")).alias("loc"), "updated_at", F.lit("weekly").alias("frequency"), F.lit(0.8).alias("priority"))
    return front.unionByName(cats).unionByName(fixed).unionByName(pages)


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(sign), F.lit(code))
    return json


def _object(**fields: object) -> Column:
    """A struct for to_json; names have '_' for '@'; null fields are left out there."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(("@" + k[1:]) if k.startswith("_") else k) for k, v in fields.items()))


def publisher() -> Column:
    logo = _object(_type="ImageObject", url=f"{SITE}/logo.png", width=512, height=512)
    policy = f"{SITE}/politica-editorial"
    return _object(_type="NewsMediaOrganization", _id=f"{SITE}/#organizacao", name=SITE_NAME, url=SITE, logo=logo, ethicsPolicy=policy, publishingPrinciples=policy)


def news_article() -> Column:
    """The NewsArticle of a row, as a struct."""
    url, author = address(F.col("slug")), F.col("source_author")
    quoted = _object(
        _type="NewsArticle", name=F.col("source_title"), url=F.col("source_url"), publisher=_object(_type="Organization", name=F.col("source_name")), author=F.when(author.isNotNull(), _object(_type="Person", name=author)),
    )
    return _object(
        _context="https://schema.org", _type="NewsArticle", _id=F.concat(url, F.lit("#artigo")), mainEntityOfPage=_object(_type="WebPage", _id=url), url=url, headline=brief(shown_title(F.col("title"), F.col("source_title")), HEADLINE),
        description=description(F.col("dek")), image=F.array(F.coalesce("image_url", F.lit(f"{SITE}/og-default.png"))), datePublished=iso(F.col("published_at")), dateModified=iso(F.col("updated_at")), inLanguage="pt-BR",
        isAccessibleForFree=True, articleSection=label(F.col("category_slug")), keywords=F.when(F.size("tags") > 0, F.array_join("tags", ", ")), author=_object(_type="Organization", name=f"Redação {SITE_NAME}", url=SITE), publisher=publisher(),
        isBasedOn=F.col("source_url"), citation=quoted, creditText=F.concat(F.lit("Com base em reportagem de "), F.col("source_name")),
    )


def trail() -> Column:
    """The BreadcrumbList of a row: home, category, title."""
    steps = (F.lit("Início"), F.lit(f"{SITE}/")), (label(F.col("category_slug")), F.concat(F.lit(f"{SITE}/categoria/"), F.col("category_slug"))), (shown_title(F.col("title"), F.col("source_title")), address(F.col("slug")))
    items = F.array(*(_object(_type="ListItem", position=k + 1, name=name, item=loc) for k, (name, loc) in enumerate(steps)))
    return _object(_context="https://schema.org", _type="BreadcrumbList", itemListElement=items)


def json_ld(articles: DataFrame) -> DataFrame:
    """(doc_id, article, trail) JSON-LD of published articles; null fields are left out."""
    return published(articles).select("doc_id", script_safe(F.to_json(news_article())).alias("article"), script_safe(F.to_json(trail())).alias("trail"))


def site_json_ld(articles: DataFrame) -> DataFrame:
    """(doc_id, kind, json): the site's own documents, as every published article's page holds them."""
    search = F.struct(F.lit("SearchAction").alias("@type"), _object(_type="EntryPoint", urlTemplate=f"{SITE}/busca?q={{search_term_string}}").alias("target"), F.lit("required name=search_term_string").alias("query-input"))
    site = _object(_context="https://schema.org", _type="WebSite", _id=f"{SITE}/#site", name=SITE_NAME, url=SITE, description=ABOUT, inLanguage="pt-BR", publisher=publisher(), potentialAction=search)
    own = F.struct(F.lit("https://schema.org").alias("@context"), publisher()["@type"].alias("@type"), *(publisher()[c].alias(c) for c in ("@id", "name", "url", "logo", "ethicsPolicy", "publishingPrinciples")))
    return published(articles).select("doc_id", F.explode(F.array(F.struct(F.lit("site").alias("kind"), F.to_json(site).alias("json")), F.struct(F.lit("organization").alias("kind"), F.to_json(own).alias("json")))).alias("r")).select("doc_id", "r.*")


def metadata(articles: DataFrame) -> DataFrame:
    """(doc_id, title, description, canonical, category, keywords, og struct, twitter struct, author) of published articles' pages."""
    title, about, url = shown_title(F.col("title"), F.col("source_title")), description(F.col("dek")), address(F.col("slug"))
    image = F.coalesce("image_url", F.lit(f"{SITE}/og-default.png"))
    og = F.struct(F.lit("article").alias("type"), url.alias("url"), F.lit(SITE_NAME).alias("siteName"), F.lit("pt_BR").alias("locale"), title.alias("title"), about.alias("description"), image.alias("image"), iso(F.col("published_at")).alias("publishedTime"), iso(F.col("updated_at")).alias("modifiedTime"), label(F.col("category_slug")).alias("section"))
    twitter = F.struct(F.lit("summary_large_image").alias("card"), title.alias("title"), about.alias("description"), image.alias("image"))
    return published(articles).select("doc_id", title.alias("title"), about.alias("description"), url.alias("canonical"), label(F.col("category_slug")).alias("category"), F.array_join("tags", ",").alias("keywords"), og.alias("og"), twitter.alias("twitter"), F.coalesce("source_author", "source_name").alias("author"))


def event_log(rows: DataFrame, event: str, columns: tuple[str, ...]) -> DataFrame:
    """(line): a JSON line a row with its event's name; null fields are left out."""
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), *columns)).alias("line"))
