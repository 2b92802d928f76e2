"""Queries of the exports, over the story view."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import dims
from .plans import exports
from .plans.exports import ABOUT, SITE, SITE_NAME
from .registry import query
from .sources.tables import NOW, STORIES_SQL, stories

TOP = "order by published_at desc, doc_id desc"


def xml(value: str) -> str:
    signs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;"))
    out = f"regexp_replace({value}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    for a, b in signs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def brief(value: str, most: int) -> str:
    """SQL of functions.text.brief."""
    clean = f"trim(regexp_replace({value}, '[\\s\\x{{a0}}\\x{{202f}}\\x{{2003}}\\x{{2009}}]+', ' ', 'g'))"
    head = f"left({clean}, {most - 1})"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    return f"case when length({clean}) <= {most} then {clean} else concat(rtrim(case when contains({head}, ' ') and {last} > {most * 0.6} then left({head}, {last}) else {head} end), '…') end"


LABEL = "case category_slug " + " ".join(f"when '{c[0]}' then '{c[1]}'" for c in dims.CATEGORIES) + " else 'Igreja no Mundo' end"
ABOUT_SQL = f"case when trim(coalesce(dek, '')) = '' or {brief('dek', 200)} = '' then '{ABOUT}' else {brief('dek', 200)} end"
SHOWN = "case when trim(coalesce(title, '')) = '' then source_title else trim(title) end"
STAMP = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
MAIL_STAMP = "strftime(make_timestamp({0} * 1000000), '%a, %d %b %Y %H:%M:%S GMT')"
VIEW = STORIES_SQL + f", v as (select *, {LABEL} label, {ABOUT_SQL} about, {SHOWN} shown, concat('{SITE}/noticia/', slug) url, {STAMP.format('published_at')} iso_published, {STAMP.format('updated_at')} iso_updated from pub)"
ITEM = f"""concat_ws(chr(10), '    <item>', concat('      <title>', {xml('shown')}, '</title>'), concat('      <link>', {xml('url')}, '</link>'), concat('      <guid isPermaLink="true">', {xml('url')}, '</guid>'),
 concat('      <pubDate>', {MAIL_STAMP.format('published_at')}, '</pubDate>'), concat('      <category>', label, '</category>'), '      <dc:creator>Redação {SITE_NAME}</dc:creator>',
 concat('      <description><![CDATA[', replace(concat(about, ' (Com base em reportagem de ', source_name, ' — ', source_url, ')'), ']]>', ']]&gt;'), ']]></description>'), concat('      <source url="', {xml('source_url')}, '">', {xml('source_name')}, '</source>'),
 case when image_url is not null then concat('      <enclosure url="', image_url, '" type="image/jpeg" />') end, '    </item>')"""


@query("rss_export", VIEW + f" select doc_id, published_at, {ITEM} as item from v {TOP} limit 50")
def rss_export(s, d):
    return exports.rss_rows(stories(s, d))


@query("rss_document", VIEW + f""", i as (select doc_id, published_at, {ITEM} item from v {TOP} limit 50) select count(*)::int as n_items, concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/">', '  <channel>', '    <title>{SITE_NAME}</title>', '    <link>{SITE}</link>',
 '    <description>{ABOUT}</description>', '    <language>pt-BR</language>', concat('    <lastBuildDate>', {MAIL_STAMP.format('max(published_at)')}, '</lastBuildDate>'), '    <ttl>15</ttl>', '    <atom:link href="{SITE}/feed.xml" rel="self" type="application/rss+xml" />', string_agg(item, chr(10) {TOP}), '  </channel>', '</rss>', '') as document from i""")
def rss_document(s, d):
    return exports.rss_document(stories(s, d))


ENTRY = f"""concat_ws(chr(10), '  <url>', concat('    <loc>', {xml('url')}, '</loc>'), '    <news:news>', '      <news:publication>', '        <news:name>{SITE_NAME}</news:name>', '        <news:language>pt</news:language>', '      </news:publication>',
 concat('      <news:publication_date>', iso_published, '</news:publication_date>'), concat('      <news:title>', {xml('shown')}, '</news:title>'), '    </news:news>', '  </url>')"""


@query("news_sitemap", VIEW + f" select doc_id, url as loc, published_at, {ENTRY} as entry from v where published_at >= {NOW - 48 * 3600} {TOP} limit 1000")
def news_sitemap(s, d):
    return exports.news_sitemap(stories(s, d), NOW)


_FIXED = " union all ".join(f"select 3, '{SITE}/{p}', null, 'yearly', 0.3::double" for p in dims.FIXED_PAGES)


@query("sitemap", VIEW + f""", r as (select * from v {TOP} limit 50000), n as (select arg_max(updated_at, row(published_at, doc_id)) u from r) select 0 as section, '{SITE}' as loc, u as updated_at, 'hourly' as frequency, 1.0::double as priority from n union all select 1, '{SITE}/noticias', u, 'hourly', 0.9::double from n
 union all select 2, concat('{SITE}/categoria/', category_slug), max(updated_at), 'daily', 0.7::double from r group by category_slug union all {_FIXED} union all select 4, url, updated_at, 'weekly', 0.8::double from r""")
def sitemap(s, d):
    return exports.sitemap(stories(s, d))


_PUBLISHER = f"json_object('@type', 'NewsMediaOrganization', '@id', '{SITE}/#organizacao', 'name', '{SITE_NAME}', 'url', '{SITE}', 'logo', json_object('@type', 'ImageObject', 'url', '{SITE}/logo.png', 'width', 512, 'height', 512), 'ethicsPolicy', '{SITE}/politica-editorial', 'publishingPrinciples', '{SITE}/politica-editorial')"
_CITED = "case when source_author is null then json_object('@type', 'NewsArticle', 'name', source_title, 'url', source_url, 'publisher', json_object('@type', 'Organization', 'name', source_name)) else json_object('@type', 'NewsArticle', 'name', source_title, 'url', source_url, 'publisher', json_object('@type', 'Organization', 'name', source_name), 'author', json_object('@type', 'Person', 'name', source_author)) end"
_ARTICLE = f"""json_object('@context', 'https://schema.org', '@type', 'NewsArticle', '@id', concat(url, '#artigo'), 'mainEntityOfPage', json_object('@type', 'WebPage', '@id', url), 'url', url, 'headline', {brief('shown', 110)}, 'description', about, 'image', json_array(coalesce(image_url, '{SITE}/og-default.png')),
 'datePublished', iso_published, 'dateModified', iso_updated, 'inLanguage', 'pt-BR', 'isAccessibleForFree', true, 'articleSection', label, 'keywords', concat('igreja, ', source_name), 'author', json_object('@type', 'Organization', 'name', 'Redação {SITE_NAME}', 'url', '{SITE}'), 'publisher', {_PUBLISHER},
 'isBasedOn', source_url, 'citation', {_CITED}, 'creditText', concat('Com base em reportagem de ', source_name))"""
_TRAIL = f"""json_object('@context', 'https://schema.org', '@type', 'BreadcrumbList', 'itemListElement', json_array(json_object('@type', 'ListItem', 'position', 1, 'name', 'Início', 'item', '{SITE}/'), json_object('@type', 'ListItem', 'position', 2, 'name', label, 'item', concat('{SITE}/categoria/', category_slug)),
 json_object('@type', 'ListItem', 'position', 3, 'name', shown, 'item', url)))"""


def _safe(json: str) -> str:
    return f"replace(replace(replace(cast({json} as varchar), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


@query("jsonld", VIEW + f" select doc_id, {_safe(_ARTICLE)} as article, {_safe(_TRAIL)} as trail from v")
def jsonld(s, d):
    return exports.json_ld(stories(s, d))


@query("site_jsonld", STORIES_SQL + f""", j as (select 'site' as kind, cast(json_object('@context', 'https://schema.org', '@type', 'WebSite', '@id', '{SITE}/#site', 'name', '{SITE_NAME}', 'url', '{SITE}', 'description', '{ABOUT}', 'inLanguage', 'pt-BR', 'publisher', {_PUBLISHER}, 'potentialAction', json_object('@type', 'SearchAction',
 'target', json_object('@type', 'EntryPoint', 'urlTemplate', '{SITE}/busca?q={{search_term_string}}'), 'query-input', 'required name=search_term_string')) as varchar) as json union all select 'organization', cast(json_object('@context', 'https://schema.org', '@type', 'NewsMediaOrganization', '@id', '{SITE}/#organizacao', 'name', '{SITE_NAME}', 'url', '{SITE}', 'logo',
 json_object('@type', 'ImageObject', 'url', '{SITE}/logo.png', 'width', 512, 'height', 512), 'ethicsPolicy', '{SITE}/politica-editorial', 'publishingPrinciples', '{SITE}/politica-editorial') as varchar)) select doc_id, kind, json from pub, j""")
def site_jsonld(s, d):
    return exports.site_json_ld(stories(s, d))


@query("page_metadata", VIEW + f""" select doc_id, shown as title, about as description, url as canonical, label as category, concat('igreja,', source_name) as keywords, coalesce(source_author, source_name) as author, cast(json_object('type', 'article', 'url', url, 'siteName', '{SITE_NAME}', 'locale', 'pt_BR', 'title', shown, 'description', about, 'image', coalesce(image_url, '{SITE}/og-default.png'), 'publishedTime', iso_published, 'modifiedTime', iso_updated, 'section', label) as varchar) as og,
 cast(json_object('card', 'summary_large_image', 'title', shown, 'description', about, 'image', coalesce(image_url, '{SITE}/og-default.png')) as varchar) as twitter from v""")
def page_metadata(s, d):
    return exports.metadata(stories(s, d)).withColumn("og", F.to_json("og")).withColumn("twitter", F.to_json("twitter"))
