"""Queries over the tables and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions import html, text, url
from .operators import asof, merge
from .plans import classify, queue, reads, rules
from .registry import ORACLE_SQL, QUERIES, query, sql_list
from .sources.tables import ARTICLES_SQL, NOW, articles, table

NOW_TS = "2024-01-20 12:00:00"
TOP = "order by published_at desc, doc_id desc"


@query("latest_published", ARTICLES_SQL + f"select doc_id, slug, title, published_at from pub {TOP} limit 30")
def latest_published(s, d):
    return reads.latest(articles(s, d)).select("doc_id", "slug", "title", "published_at")


@query("latest_in_category", ARTICLES_SQL + f"select doc_id, slug, published_at from pub where category_slug = 'de' {TOP} limit 30")
def latest_in_category(s, d):
    return reads.latest(articles(s, d), category="de").select("doc_id", "slug", "published_at")


@query("category_page", ARTICLES_SQL + f", c as (select count(*) total, greatest(1, cast(ceil(count(*) / 12.0) as int)) pages from pub where category_slug = 'en') select doc_id, slug, title, published_at, least(2, pages) as page, pages, total from pub, c where category_slug = 'en' {TOP} limit 12 offset (select (least(2, pages) - 1) * 12 from c)")
def category_page(s, d):
    return reads.category_page(articles(s, d), "en", 2)


@query("slug_lookup", ARTICLES_SQL + "select doc_id, slug, title, status from articles_v where slug = 'doc-42'")
def slug_lookup(s, d):
    return reads.by_slug(articles(s, d), "doc-42").select("doc_id", "slug", "title", "status")


@query("related_articles", ARTICLES_SQL + "select doc_id, slug, case when category_slug = 'en' then 1 else 0 end same_category from pub where slug <> 'doc-42' order by 3 desc, published_at desc, doc_id desc limit 3")
def related_articles(s, d):
    return reads.related(articles(s, d), "doc-42", "en").select("doc_id", "slug", "same_category")


def _highlights_sql(now: int) -> str:
    return ARTICLES_SQL + f", w as (select *, 1 tier from pub where published_at >= {now - 7 * 86400} {TOP} limit 4), e as (select *, 2 tier from pub {TOP} limit 4), b as (select * from w union all select * from e) select row_number() over ({TOP}) as rank, doc_id, slug, published_at, tier from b where tier = (select min(tier) from b)"


@query("weekly_highlights", _highlights_sql(NOW))
def weekly_highlights(s, d):
    return reads.highlights(articles(s, d), NOW)


@query("weekly_fallback", _highlights_sql(NOW + 90 * 86400))
def weekly_fallback(s, d):
    return reads.highlights(articles(s, d), NOW + 90 * 86400)


@query("title_search", ARTICLES_SQL + f"select doc_id, slug from pub where contains(lower(title), 'license') or contains(lower(source_excerpt), 'license') {TOP} limit 40")
def title_search(s, d):
    return reads.search(articles(s, d), " License ").select("doc_id", "slug")


@query("nav_categories", ARTICLES_SQL + "select slug from (values ('en'), ('de'), ('pt')) t(slug) where slug in (select category_slug from pub)")
def nav_categories(s, d):
    return reads.navigation(articles(s, d), s.createDataFrame([("en",), ("de",), ("pt",)], "slug string"))


@query("categories_in_use", ARTICLES_SQL + "select distinct category_slug from pub")
def categories_in_use(s, d):
    return reads.published(articles(s, d)).select("category_slug").distinct()


@query("category_last_update", ARTICLES_SQL + "select slug, coalesce(max(published_at), 0) as last from (values ('en'), ('de'), ('pt')) t(slug) left join pub on category_slug = t.slug group by t.slug".replace("select slug,", "select t.slug,"))
def category_last_update(s, d):
    return reads.last_updates(articles(s, d), s.createDataFrame([("en",), ("de",), ("pt",)], "slug string"))


@query("status_counts", ARTICLES_SQL + "select status, count(*) as n from articles_v group by status")
def status_counts(s, d):
    return articles(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("status_pivot", ARTICLES_SQL + "select source, count(*) filter (status = 'draft') as draft, count(*) filter (status = 'published') as published, count(*) filter (status = 'failed_validation') as failed_validation from articles_v group by source")
def status_pivot(s, d):
    names = ["draft", "published", "failed_validation"]
    return articles(s, d).groupBy("source").pivot("status", names).count().na.fill(0, names)


DAYS_SQL = "select distinct cast(o_orderdate as date) as day from orders"
COVERAGE = "count(*) as days, count(*) filter (day = date '{0}') as today, count(*) filter (day >= date '{0}') as ahead, cast(max(day) as varchar) as last_day, date_diff('day', date '{0}', max(day)) as days_left, date_diff('day', date '{0}', max(day)) < 7 as alert"


def _days(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("health_report", ARTICLES_SQL + f""", a as (select count(*) filter (status = 'draft') n_draft, count(*) filter (status = 'published') n_published, count(*) filter (status = 'failed_validation') n_failed_validation from articles_v),
r as (select count(*) filter (event_type = 'error' and ts >= timestamp '{NOW_TS}' - interval 6 hour and ts <= timestamp '{NOW_TS}') failures, arg_max(event_id, row(ts, event_id)) last_run, trunc((epoch(timestamp '{NOW_TS}') - epoch(max(ts))) / 60)::bigint idle_minutes from events),
c as (select {COVERAGE.format(NOW_TS[:10])} from ({DAYS_SQL})), x as (select * from a, r, c),
p as (select *, list_filter([case when idle_minutes is null then 'no run' when idle_minutes > 90 then concat('no run for ', idle_minutes, ' min') end, case when n_published = 0 then 'nothing published' end,
case when today = 0 then 'no day for today' when days_left < 7 then concat(days_left, ' days left') end, case when failures >= 3 then concat(failures, ' failed runs') end], lambda y: y is not null) found from x),
o as (select * exclude (found), array_to_string(found, '; ') problems, case when n_published = 0 or idle_minutes is null or idle_minutes > 90 then 'parado' when len(found) > 0 then 'degradado' else 'ok' end verdict from p) select *, case when verdict = 'parado' then 503 else 200 end http_status from o""")
def health_report(s, d):
    return queue.health(articles(s, d), table(s, d, "events"), _days(s, d), NOW_TS)


@query("calendar_coverage", f"select {COVERAGE.format('1995-06-17')} from ({DAYS_SQL})")
def calendar_coverage(s, d):
    return queue.coverage(_days(s, d), "1995-06-17")


@query("month_completeness", f"select strftime(m, '%Y-%m') as month, n, day(last_day(m)) as expected, n = day(last_day(m)) as complete from (select date_trunc('month', day) m, count(*) n from ({DAYS_SQL}) group by 1)")
def month_completeness(s, d):
    return queue.month_completeness(_days(s, d))


@query("nearest_day", f"with days as ({DAYS_SQL} where hash(cast(o_orderdate as varchar)) is not null and day(o_orderdate) % 7 = 0), probes as (select distinct cast(l_shipdate as date) as probe from lineitem) select probe, (select day from days order by abs(date_diff('day', day, probe)), day limit 1) as nearest from probes".replace("hash(cast(o_orderdate as varchar)) is not null and ", ""))
def nearest_day(s, d):
    probes = table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("probe")).distinct()
    return asof.nearest_day(probes, _days(s, d).filter(F.day("day") % 7 == 0), "probe", "day")


@query("run_tallies", "select user_id, count(*) as runs, count(*) filter (event_type = 'error') as failed, bool_or(event_type <> 'error') as succeeded from events group by user_id")
def run_tallies(s, d):
    bad = F.col("event_type") == "error"
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(bad).alias("failed"), F.bool_or(~bad).alias("succeeded"))


@query("failure_streak", "with e as (select user_id, event_type = 'error' bad, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) island from events) select user_id, max(n) as longest, max(n) >= 3 as tripped from (select user_id, island, count(*) n from e where bad group by 1, 2) group by 1")
def failure_streak(s, d):
    return queue.failure_streaks(table(s, d, "events").withColumn("bad", F.col("event_type") == "error"), "user_id", "bad", ("ts", "event_id"))


@query("failures_6h", f"select count(*) as failures from events where event_type = 'error' and ts >= timestamp '{NOW_TS}' - interval 6 hour and ts <= timestamp '{NOW_TS}'")
def failures_6h(s, d):
    at = F.lit(NOW_TS).cast("timestamp_ntz")
    return table(s, d, "events").filter((F.col("event_type") == "error") & F.col("ts").between(at - F.expr("interval 6 hours"), at)).agg(F.count(F.lit(1)).alias("failures"))


@query("last_run", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 1")
def last_run(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("coalescing_upsert", "with t as (select p_partkey, p_name, p_size from part where p_partkey % 3 <> 0), b as (select p_partkey, case when p_partkey % 2 = 0 then p_brand end p_name, p_size + 1 p_size from part where p_partkey % 3 <> 1) select coalesce(b.p_partkey, t.p_partkey) as p_partkey, case when b.p_partkey is not null then b.p_size else t.p_size end as p_size, coalesce(b.p_name, t.p_name) as p_name from t full join b on t.p_partkey = b.p_partkey")
def coalescing_upsert(s, d):
    part = table(s, d, "part")
    target = part.filter("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_size")
    batch = part.filter("p_partkey % 3 <> 1").select("p_partkey", F.expr("case when p_partkey % 2 = 0 then p_brand end").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return merge.coalescing_upsert(target, batch, "p_partkey", ("p_size",), ("p_name",))


MERGE_SQL = ARTICLES_SQL + ", k as (select *, sha256(source_excerpt) key from articles_v), t as (select distinct key from k where doc_id % 3 = 0), b as (select * from k where doc_id % 3 <> 0), f as (select key, min(doc_id) first from b group by key)"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).withColumn("key", F.sha2("source_excerpt", 256))


@query("dedupe_merge", MERGE_SQL + " select doc_id, case when t.key is null and doc_id = first then 'new' else 'duplicate' end as outcome from b left join t using (key) join f using (key)")
def dedupe_merge(s, d):
    rows = _keyed(s, d)
    return merge.classify_batch(rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 <> 0"), "key", "doc_id").select("doc_id", "outcome")


@query("content_change", "select doc_id, case when doc_id % 5 = 1 then 'updated' else 'duplicate' end as outcome from documents where doc_id % 2 = 1")
def content_change(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    hashed = lambda df: df.withColumn("hash", F.sha2("text", 256))
    edited = docs.filter("doc_id % 2 = 1").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return merge.classify_batch(hashed(docs), hashed(edited), "doc_id", "doc_id", content="hash").select("doc_id", "outcome")


SLUG = "trim(regexp_replace(lower(strip_accents(regexp_replace(title, '[\"''’‘“”]', '', 'g'))), '[^a-z0-9]+', '-', 'g'), '-')"
SLUGS_SQL = ARTICLES_SQL + f", s0 as (select doc_id, {SLUG} s, sha256(source_excerpt) h from articles_v), s1 as (select *, left(s, 80) head from s0), s2 as (select doc_id, h, case when length(s) <= 80 then s else rtrim(case when contains(head, '-') and 80 - instr(reverse(head), '-') > 40 then left(head, 80 - instr(reverse(head), '-')) else head end, '-') end base_slug from s1)"


def _slugs(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("doc_id", text.slugify(F.col("title")).alias("base_slug"), F.sha2("source_excerpt", 256).alias("h"))


@query("slugify", SLUGS_SQL + " select doc_id, base_slug from s2")
def slugify(s, d):
    return _slugs(s, d).select("doc_id", "base_slug")


_CUT = "case when length(base_slug) <= 73 then base_slug else rtrim(case when contains(left(base_slug, 73), '-') and 73 - instr(reverse(left(base_slug, 73)), '-') > 36.5 then left(base_slug, 73 - instr(reverse(left(base_slug, 73)), '-')) else left(base_slug, 73) end, '-') end"


@query("slug_collisions", SLUGS_SQL + f""", w as (select doc_id, nullif(base_slug, '') a, concat(case when {_CUT} = '' then 'noticia' else {_CUT} end, '-', left(h, 6)) b, concat('doc-', doc_id) own from s2 where doc_id % 3 <> 0),
 u as (select base_slug s from s2 where doc_id % 3 = 0 union select own from w), c as (select *, min(doc_id) over (partition by a) = doc_id and a is not null and a not in (select s from u) first from w),
 l as (select * from c where not first), k as (select doc_id, b, own, min(doc_id) over (partition by b) = doc_id and b not in (select s from u) and b not in (select a from c where first) holds from l)
 select doc_id, a as final_slug from c where first union all select doc_id, case when holds then b else own end from k""")
def slug_collisions(s, d):
    """The first free one of each row's wishes: its slug, the slug with a suffix, its present one."""
    rows = _slugs(s, d).withColumn("short", F.substring("h", 1, 6)).withColumn("own", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return merge.free_slugs(rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 3 = 0").select("base_slug"), "base_slug", "doc_id", "short", present="own").select("doc_id", "final_slug")


_SCORES = ", ".join("row(" + " + ".join(f"cast(contains(strip_accents(lower(title)), '{t}') as int)" for t in terms) + f", {-k}, '{slug}')" for k, (slug, terms) in enumerate(dims.LEXICON))


@query("lexicon_category", ARTICLES_SQL + f", m as (select doc_id, list_max([{_SCORES}]) best from articles_v) select doc_id, case when best[1] > 0 then best[3] else 'mundo' end as category from m")
def lexicon_category(s, d):
    return articles(s, d).select("doc_id", F.coalesce(classify.lexicon_category(F.col("title")), F.lit(dims.DEFAULT_CATEGORY)).alias("category"))


@query("path_category", "with p as (select page_id, list_slice(list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)), '/'), lambda x: x <> ''), 1, 2) seg from pages) select page_id, coalesce(" + ", ".join(f"case when seg[{i}] = '{k}' then '{v}' end" for i in (1, 2) for k, v in dims.PATH_CATEGORY.items()) + ", 'mundo') as category from p")
def path_category(s, d):
    return table(s, d, "pages").select("page_id", F.coalesce(classify.path_category(F.col("url")), F.lit(dims.DEFAULT_CATEGORY)).alias("category"))


@query("url_canonical", f"""with p as (select page_id, regexp_replace(trim(url), '#.*$', '') u from pages), q as (select page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]+)', 1)) host, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+$', '') path,
list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(regexp_extract(x, '^([^=]*)', 1)), '{dims.TRACKING}'))) params from p)
select page_id, concat(scheme, '://', host, case when path = '' then '/' else path end, case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end) as canonical from q""")
def url_canonical(s, d):
    return table(s, d, "pages").select("page_id", url.canonical(F.col("url")).alias("canonical"))


@query("read_pages")
def read_pages(s, d):
    return html.read_pages(table(s, d, "pages"))


WORDS = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}'']+)', 1)"


def _stop_sql(names: tuple) -> str:
    return f"len(list_filter(w, lambda x: list_contains({sql_list(names)}, x)))"


@query("language_profile", f"with p as (select doc_id, text, {WORDS} w from documents), c as (select doc_id, text, {_stop_sql(dims.ENGLISH)} en, {_stop_sql(dims.PORTUGUESE)} pt from p) select doc_id, en, pt, case when en + pt = 0 then 1.0::double else en::double / (en + pt) end as english_share, len(regexp_extract_all(text, '{dims.DIACRITICS}'))::double / greatest(length(text), 1) as diacritics, len(list_filter(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: trim(x) <> '')) as paragraphs from c")
def language_profile(s, d):
    c = F.col("counts")
    rows = table(s, d, "documents").withColumn("counts", text.stop_counts(F.col("text")))
    return rows.select("doc_id", c["en"].alias("en"), c["pt"].alias("pt"), text.english_share(c).alias("english_share"), text.diacritic_density(F.col("text")).alias("diacritics"), text.paragraphs(F.col("text")).alias("paragraphs"))


@query("reading_time", f"select doc_id, greatest(1, cast(ceil(len({WORDS}) / 200.0) as bigint)) as minutes from documents")
def reading_time(s, d):
    return table(s, d, "documents").select("doc_id", text.reading_minutes(F.col("text")).alias("minutes"))


@query("preflight", ARTICLES_SQL + "select doc_id, length(coalesce(source_excerpt, '')) >= 1750 and coalesce(source_length, 0) > 0 as ready from articles_v")
def preflight(s, d):
    return rules.preflight(articles(s, d)).select("doc_id", "ready")


@query("work_queue", ARTICLES_SQL + f"select doc_id, published_at from articles_v where status = 'draft' and (doc_id % 2 = 0 or {NOW} - (doc_id % 100) * 60 < {NOW} - 1800) {TOP} limit 25")
def work_queue(s, d):
    tried = F.when(F.col("doc_id") % 2 == 1, F.lit(NOW) - (F.col("doc_id") % 100) * 60)
    return queue.work_queue(articles(s, d).withColumn("attempted_at", tried), NOW, 25).select("doc_id", "published_at")


@query("requeue", ARTICLES_SQL + f"select doc_id, 'draft' as status, cast(doc_id % 4 + 1 as bigint) as attempts from articles_v where status = 'failed_validation' and published_at >= {NOW - 3 * 86400} and doc_id % 4 < 2 and doc_id % 3 = 0 order by published_at desc, doc_id desc limit 50")
def requeue(s, d):
    errors = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("resposta_invalida: bloco"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("resposta_invalida"), F.lit("numeros: 7"))).otherwise(F.array().cast("array<string>"))
    return queue.requeue(articles(s, d).withColumn("validation_errors", errors).withColumn("attempts", F.col("doc_id") % 4), NOW).select("doc_id", "status", "attempts")


@query("tags_normalised", "select doc_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 6), ',') as tags from (select doc_id, list_filter(list_transform(string_split(text, ' '), lambda t: left(regexp_replace(lower(trim(t)), '[#\"'']', '', 'g'), 32)), lambda t: length(t) >= 2) l from documents)")
def tags_normalised(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(text.tags(F.split("text", " ")), ",").alias("tags"))


# The other modules add theirs.
from . import queries_editorial, queries_exports, queries_ingest, queries_results, queries_site, queries_stream  # noqa: E402, F401
