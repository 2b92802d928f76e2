"""Queries of the site's pages and the functions behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import dims
from .functions import dates, html, text, url
from .plans import classify, exports, reads
from .queries_exports import LABEL, TOP, brief
from .registry import query, sql_cut, sql_list
from .sources.tables import NOW, STORIES_SQL, stories, table

def _id():
    return F.col("doc_id")


@query("topic_counts", STORIES_SQL + "select doc_id, count(*) over () as visible from pub where category_slug in ('vaticano', 'santos')")
def topic_counts(s, d):
    """Articles of chosen topics and how many are visible."""
    return reads.shown_topics(stories(s, d), ("vaticano", "santos")).select("doc_id", F.col("visible").cast("long").alias("visible"))


@query("lead_and_rest", STORIES_SQL + f", r as (select doc_id, row_number() over ({TOP}) as rank from pub {TOP} limit 30) select doc_id, rank, case when rank = 1 then 'lead' when rank <= 3 then 'side' else 'rest' end as part from r")
def lead_and_rest(s, d):
    return reads.lead_and_rest(reads.published(stories(s, d))).select("doc_id", F.col("rank").cast("long").alias("rank"), "part")


@query("top_of_category", STORIES_SQL + f"select doc_id, slug from pub where category_slug = 'santos' {TOP} limit 1")
def top_of_category(s, d):
    return reads.latest(stories(s, d), k=1, category="santos").select("doc_id", "slug")


@query("refresh_list", STORIES_SQL + f"select slug, category_slug from pub where updated_at >= {NOW - 20 * 86400} order by updated_at desc, doc_id desc limit 20")
def refresh_list(s, d):
    return reads.refresh_list(stories(s, d), NOW - 20 * 86400, 10)


_KNOWN = ", ".join(f"('{c[0]}', '{c[1]}', {k}, {c[2]}, {c[3]})" for k, c in enumerate(dims.CATEGORIES))


@query("chips", STORIES_SQL + f"select slug, label, position from (values {_KNOWN}) t(slug, label, position, nav, chip) where chip and slug in (select category_slug from pub)")
def chips(s, d):
    """Categories with articles that are flagged for the chips."""
    return reads.flagged_categories(stories(s, d), 3)


@query("navigation", STORIES_SQL + f"select slug, label, position from (values {_KNOWN}) t(slug, label, position, nav, chip) where nav and slug in (select category_slug from pub)")
def navigation(s, d):
    return reads.flagged_categories(stories(s, d), 2)


@query("with_image", STORIES_SQL + "select doc_id, image_url from pub where image_url is not null")
def with_image(s, d):
    return reads.published(stories(s, d)).filter(F.col("image_url").isNotNull()).select("doc_id", "image_url")


@query("page_window", """with p as (select doc_id, cast(1 + doc_id % 20 as int) total, cast(1 + (doc_id // 20) % (1 + doc_id % 20) as int) cur from documents), n as (select *, list_sort(list_distinct(list_concat([1, total], list_filter([cur - 1, cur, cur + 1], lambda x: x >= 1 and x <= total)))) shown from p)
 select doc_id, case when total <= 7 then array_to_string(range(1, total + 1), ' ') else array_to_string(list_transform(shown, lambda x, i: case when i > 1 and x - shown[i - 1] > 1 then concat('… ', x) else cast(x as varchar) end), ' ') end as shown from n""")
def page_window(s, d):
    """Page numbers with gaps."""
    total = (1 + _id() % 20).cast("int")
    shown = reads.page_window((1 + (_id() / 20).cast("long") % (1 + _id() % 20)).cast("int"), total)
    return table(s, d, "documents").select("doc_id", F.array_join(F.transform(shown, lambda p: F.coalesce(p.cast("string"), F.lit("…"))), " ").alias("shown"))


@query("display_fields", STORIES_SQL + f"select doc_id, case when trim(title) = '' then source_title else trim(title) end as shown, coalesce(dek, title) as quote, {LABEL} as label, {brief('coalesce(dek, source_title)', 60)} as line from stories")
def display_fields(s, d):
    """What cards show: the title or the source's, dek or title, the category's label, a cut line."""
    return stories(s, d).select("doc_id", exports.shown_title(F.col("title"), F.col("source_title")).alias("shown"), F.coalesce("dek", "title").alias("quote"), classify.label(F.col("category_slug")).alias("label"), text.brief(F.coalesce("dek", "source_title"), 60).alias("line"))


@query("text_shaping", f"""select doc_id, {sql_cut('trim(text)', 80)} as cut, case doc_id % 4 when 0 then 'T' when 1 then 'T' when 2 then 'T' else 'T - Outro' end as unbranded, doc_id % 3 = 0 as blank, concat(left(concat('x | ', text), 160)) as summed,
 replace(concat(left(text, 50), ']]>'), ']]>', ']]&gt;') as cdata, concat('[', '"', doc_id, '","b"]') as tags_json, doc_id % 5 < 2 as safe from documents""")
def text_shaping(s, d):
    """Cut texts, titles without brands, blank cells, summaries, CDATA, arrays as JSON and back, safe addresses."""
    title = F.when(_id() % 4 == 0, "T | Marca").when(_id() % 4 == 1, "T - Marca").when(_id() % 4 == 2, " T – Marca").otherwise("T - Outro")
    cell = F.when(_id() % 3 == 0, " –. ").otherwise("a.")
    address = F.when(_id() % 5 == 0, "https://a.example/x").when(_id() % 5 == 1, "HTTP://a").when(_id() % 5 == 2, "javascript:x").when(_id() % 5 == 3, "/a")
    tags = F.from_json(F.to_json(F.array(_id().cast("string"), F.lit("b"))), "array<string>")
    return table(s, d, "documents").select(
        "doc_id", text.shorten(F.col("text"), 80).alias("cut"), text.without_brand(title, "Marca").alias("unbranded"), text.is_blank(cell).alias("blank"), text.summary(F.array(F.lit("x"), F.col("text"))).alias("summed"),
        text.cdata_safe(F.concat(F.substring("text", 1, 50), F.lit("]]>"))).alias("cdata"), F.to_json(tags).alias("tags_json"), url.is_safe(address).alias("safe"),
    )


@query("source_blocks", "select doc_id, concat('Corpo ', doc_id, chr(10), chr(10), 'Fim', chr(10), chr(10), '> **Fonte:** [', source, '](https://a.example/', doc_id, ')', chr(10)) as body, true as held, false as before from documents")
def source_blocks(s, d):
    """Bodies without the model's own attribution, with the site's."""
    raw = F.concat(F.lit("Corpo "), _id().cast("string"), F.lit("\n\n> **Fontes**: x\n\nFim\n\nFonte: y\n"))
    raw = F.replace(raw, F.lit("**Fontes**:"), F.lit("**Fontes: z"))
    body = text.final_body(text.without_attribution(raw), F.col("source"), F.concat(F.lit("https://a.example/"), _id().cast("string")))
    return table(s, d, "documents").select("doc_id", body.alias("body"), text.has_source_block(body).alias("held"), text.has_source_block(raw).alias("before"))


@query("markdown_blocks", "select doc_id, unnest([0, 1, 2, 3]) as position, unnest(['h2', 'quote', 'list', 'p']) as kind, unnest([concat('Título ', doc_id), 'Citação', concat('um', chr(10), 'dois'), concat('Texto ', doc_id)]) as said from documents")
def markdown_blocks(s, d):
    """Blocks of a text with their kind and place."""
    md = F.concat(F.lit("\n## Título "), _id().cast("string"), F.lit("\n\n> Citação\n\n\n- um\n-  dois\n\n  Texto "), _id().cast("string"), F.lit("  \n"))
    rows = table(s, d, "documents").select("doc_id", F.posexplode(text.blocks(md)).alias("position", "b"))
    return rows.select("doc_id", "position", "b.kind", F.col("b.text").alias("said"))


@query("markdown_inline", """select doc_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as position, unnest(['text', 'link', 'text', 'bold', 'text', 'italic', 'text', 'text']) as kind, unnest(['Veja ', concat('site ', doc_id), ' e ', 'forte', ' ou ', 'leve', '; ', 'ruim']) as said,
 unnest([null, concat('https://x.example/', doc_id), null, null, null, null, null, null]) as url from documents""")
def markdown_inline(s, d):
    """Links, bold and italic parts of a line; links with other schemes are text."""
    i = _id().cast("string")
    line = F.concat(F.lit("Veja [site "), i, F.lit("](https://x.example/"), i, F.lit(") e **forte** ou *leve*; [ruim](javascript:x)"))
    rows = table(s, d, "documents").select("doc_id", F.posexplode(text.inline_tokens(line)).alias("position", "t"))
    return rows.select("doc_id", "position", "t.kind", F.col("t.text").alias("said"), "t.url")


@query("routes", """select doc_id, concat('/noticias', case when doc_id % 2 = 0 and doc_id % 3 > 0 then concat('?categoria=', lang, '&pagina=', 1 + doc_id % 3) when doc_id % 2 = 0 then concat('?categoria=', lang) when doc_id % 3 > 0 then concat('?pagina=', 1 + doc_id % 3) else '' end) as archive,
 case doc_id % 3 when 0 then 'https://portal.example/a' when 1 then 'https://portal.example/b' else 'HTTP://c.example' end as absolute, 'portalbot' as agent, case when doc_id % 2 = 0 then concat('https://c.example/calendario-', 2000 + doc_id % 100) else 'https://c.example/calendario' end as calendar from documents""")
def routes(s, d):
    """Archive routes, absolute addresses, agent tokens, calendar addresses."""
    archive = url.archive_route(F.when(_id() % 2 == 0, F.col("lang")), (1 + _id() % 3).cast("int"))
    path = F.when(_id() % 3 == 0, "/a").when(_id() % 3 == 1, "b").otherwise("HTTP://c.example")
    year = F.when(_id() % 2 == 0, (2000 + _id() % 100).cast("int"))
    return table(s, d, "documents").select("doc_id", archive.alias("archive"), url.absolute(path, exports.SITE).alias("absolute"), url.agent_token(F.when(_id() % 2 == 0, " PortalBot/1.0 x").otherwise("PORTALBOT (y)")).alias("agent"), url.calendar_address("https://c.example", year).alias("calendar"))


@query("content_keys", "select doc_id, sha256(concat('https://a.example/', doc_id, '?a=1')) as key, sha256(concat('T ', doc_id, chr(10), trim(text))) as content, case when doc_id % 2 = 0 then sha256(concat('https://b.example/', doc_id)) end as safe_key from documents")
def content_keys(s, d):
    """Digests of addresses and of what a source says; none for what is no address."""
    i = _id().cast("string")
    broken = F.when(_id() % 2 == 0, F.concat(F.lit("https://b.example/"), i, F.lit("/#x"))).otherwise(F.lit("sem endereço"))
    return table(s, d, "documents").select(
        "doc_id", url.dedupe_hash(F.concat(F.lit("HTTPS://A.example:443/"), i, F.lit("/?a=1&utm_source=b"))).alias("key"), url.content_hash(F.concat(F.lit(" T "), i), F.col("text")).alias("content"), url.dedupe_hash(broken).alias("safe_key"),
    )


@query("lookups", "select doc_id, case doc_id % 3 when 0 then 'Santos' else 'Igreja no Mundo' end as label, case doc_id % 4 when 0 then 'Bispo' when 1 then 'homilia' end as translation, case doc_id % 3 when 0 then 'vendor/model-a' when 1 then 'vendor/other' else 'vendor/default' end as model from documents")
def lookups(s, d):
    """Labels with a default, glossary terms in any letter case, aliases that pass."""
    term = F.when(_id() % 4 == 0, " BISHOP").when(_id() % 4 == 1, "Homily").otherwise("unknown")
    model = classify.resolved(F.when(_id() % 3 == 0, " a ").when(_id() % 3 == 1, "vendor/other").otherwise(" "), {"a": "vendor/model-a"}, "vendor/default")
    rows = table(s, d, "documents").select("doc_id", term.alias("term"), classify.label(F.when(_id() % 3 == 0, "santos").otherwise("desconhecida")).alias("label"), model.alias("model"))
    return reads.glossary(rows, dims.ONE_WORD_TERMS).select("doc_id", "label", "translation", "model")


_AT = "make_timestamp((published_at - 10800) * 1000000)"  # the zone of the portal is three hours behind UTC in the tables' years


@query("portal_dates", STORIES_SQL + f"""select doc_id, concat(day({_AT}), ' de ', {sql_list(dims.MONTHS_LONG)}[month({_AT})], ' de ', year({_AT})) as long_date, concat(day({_AT}), ' ', {sql_list(dims.MONTHS_SHORT)}[month({_AT})]) as short_date, concat(day({_AT}), ' ', {sql_list(dims.MONTHS_SHORT)}[month({_AT})], ', ', strftime({_AT}, '%H:%M')) as short_instant,
 concat({sql_list(dims.WEEKDAYS_LONG)}[dayofweek({_AT}) + 1], ', ', day({_AT}), ' de ', {sql_list(dims.MONTHS_LONG)}[month({_AT})], ' de ', year({_AT})) as full_day, strftime({_AT}, '%Y-%m-%d') as civil_day, strftime(make_timestamp(published_at * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as iso,
 strftime(make_timestamp(published_at * 1000000), '%a, %d %b %Y %H:%M:%S GMT') as mail, cast(year({_AT}) as int) as year, date_diff('day', cast({_AT} as date), date '2024-02-01')::int as days_to from stories""")
def portal_dates(s, d):
    """Instants as the portal shows them, in its time zone."""
    at = F.col("published_at")
    return stories(s, d).select(
        "doc_id", dates.long_date(at).alias("long_date"), dates.short_date(at).alias("short_date"), dates.short_instant(at).alias("short_instant"), dates.full_day(at).alias("full_day"), dates.civil_day(at).alias("civil_day"), dates.iso(at).alias("iso"), dates.rfc822(at).alias("mail"),
        dates.portal_year(at).alias("year"), dates.days_between(dates.civil_day(at), F.lit("2024-02-01")).alias("days_to"),
    )


@query("clean_texts", "select doc_id, case doc_id % 4 when 0 then concat('Um ', doc_id, chr(10), chr(10), 'dois & três') when 1 then concat('a < b ', doc_id) when 3 then 'linha' || chr(10) || 'fim' end as cleaned from documents")
def clean_texts(s, d):
    """Text of what may be HTML or not."""
    i = _id().cast("string")
    raw = F.when(_id() % 4 == 0, F.concat(F.lit("<style>x</style><p>Um  "), i, F.lit("</p><p>dois &amp; três</p>"))).when(_id() % 4 == 1, F.concat(F.lit("  a < b "), i)).when(_id() % 4 == 2, F.lit("<p> </p>")).otherwise(F.lit("linha<br>fim"))
    return table(s, d, "documents").select("doc_id", html.clean_text(raw).alias("cleaned"))


@query("page_fields", "select doc_id, case when doc_id % 3 > 0 then concat('T', doc_id) else 'tw' end as og_title, case when doc_id % 2 = 0 then 'desc' else 'tw desc' end as og_description, 'https://i.example/1.jpg' as og_image, 'Ana' as og_author, '2024-01-01' as og_published, doc_id % 5 <> 0 as by_container, case when doc_id % 5 = 0 then 4 else 3 end::bigint as n_paragraphs from documents")
def page_fields(s, d):
    """Fields of pages' heads and bodies: names by preference, the container before the rest of the page."""
    i = _id().cast("string")
    meta = lambda name, value: f'<meta property="{name}" content="{value}">'
    p = lambda word: f"<p>{' '.join([word] * 20)}</p>"
    head = F.concat(
        F.lit("<html><head>"), F.when(_id() % 3 > 0, F.concat(F.lit('<meta property="og:title" content="T'), i, F.lit('"><meta property="og:title" content="later">'))).otherwise(F.lit("")), F.lit(meta("twitter:title", "tw")), F.lit(meta("twitter:description", "tw desc")),
        F.when(_id() % 2 == 0, F.lit(meta("OG:Description", "desc"))).otherwise(F.lit("")), F.lit(meta("og:image", " https://i.example/1.jpg ") + meta("og:image", "https://i.example/2.jpg") + meta("author", "Ana") + meta("article:published_time", "2024-01-01") + "</head><body>" + meta("og:title", "body") + p("menuu")),
    )
    box = F.when(_id() % 5 == 0, "other").otherwise("wide entry-content")
    body = F.concat(F.lit('<div class="'), box, F.lit('">' + p("corpo") * 2 + "<aside>" + p("nunca") + "</aside><p>curto</p>" + p("final") + "</div></body></html>"))
    pages = table(s, d, "documents").select("doc_id", F.concat(head, body).alias("html"))
    return html.read_pages(pages, "doc_id").select("doc_id", "og_title", "og_description", "og_image", "og_author", "og_published", "by_container", "n_paragraphs")


SAMPLE_DAYS = (("07-26", "Domingo", "Festa A", "branco"), ("07-27", "Segunda", "Féria", None), ("07-28", "Terça", "Festa B", "vermelho"))


@query("sample_days", "select cast(day as varchar) as date, feast, color from (select distinct cast(o_orderdate as date) as day from orders) join (values ('07-26', 'Festa A', 'branco'), ('07-27', 'Féria', null), ('07-28', 'Festa B', 'vermelho')) t(md, feast, color) on strftime(day, '%m-%d') = md")
def sample_days(s, d):
    """The stored days that the in-memory source describes, in every year."""
    known = s.createDataFrame([(a, f, c) for a, _, f, c in SAMPLE_DAYS], "at string, feast string, color string")
    days = table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.join(F.broadcast(known), F.date_format("day", "MM-dd") == F.col("at")).select(F.col("day").cast("string").alias("date"), "feast", "color")
