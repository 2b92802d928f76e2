"""Queries of kept results and of the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import upper_each
from .plans import adapt, glossary, kept, reads, schedule
from .registry import query
from .sources.shared import fresh_path
from .sources.shared import kept as kept_table
from .sources.tables import ARTICLES_SQL, articles, table


def _kept(s: SparkSession, d: str) -> kept.Kept:
    """Every third article first, then two batches: new ones with some that are withdrawn, the rest with some that change their category."""
    base = kept_table(articles(s, d).select("doc_id", *kept.COLUMNS), "articles")
    part, i = F.col("doc_id") % 3, F.col("doc_id")
    results = kept.Kept(s, fresh_path(s, "kept"))
    now = base.filter(part == 0)
    results.start(now)
    first = base.filter((part == 1) | ((part == 0) & (i % 10 == 0))).withColumn("status", F.when((part == 0) & (i % 10 == 0), "draft").otherwise(F.col("status")))
    second = base.filter((part == 2) | ((part == 1) & (i % 7 == 0))).withColumn("category_slug", F.when((part == 1) & (i % 7 == 0), "fr").otherwise(F.col("category_slug")))
    for version, batch in enumerate((first, second), 1):
        after = kept_table(kept.merged(now, batch), "articles")
        results.apply(version, kept.changes(now, batch), after)
        now = after
    return results


KEPT_SQL = ARTICLES_SQL + ", k as (select doc_id, slug, published_at, case when doc_id % 30 = 0 then 'draft' else status end status, case when doc_id % 3 = 1 and doc_id % 7 = 0 then 'fr' else category_slug end category_slug from articles_v)"


@query("kept_counts", KEPT_SQL + " select status, category_slug, count(*) as n from k group by 1, 2")
def kept_counts(s, d):
    """Counts by status and category after two batches of changes."""
    return _kept(s, d).counts(2)


@query("kept_lists", KEPT_SQL + ", e as (select 'home' tag, doc_id, slug, published_at from k where status = 'published' union all select category_slug, doc_id, slug, published_at from k where status = 'published' and category_slug is not null) select tag, row_number() over (partition by tag order by published_at desc, doc_id desc) as rank, doc_id, slug, published_at from e qualify rank <= 30")
def kept_lists(s, d):
    """The newest of home and of each category after two batches of changes."""
    return _kept(s, d).lists(2)


def _glossary(s: SparkSession, d: str) -> DataFrame:
    """Terms from the benchmark's texts: the first three words and the first word of each, with kinds by id."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(glossary.WORD), F.lit(1))
    kinds = F.array(*map(F.lit, glossary.KINDS))
    rows = table(s, d, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") >= 3)
    made = rows.select("item_id", F.posexplode(F.array(F.array_join(F.slice("w", 1, 3), " "), F.get("w", F.lit(0)))).alias("k", "term"))
    return made.select("term", upper_each(F.col("term")).alias("translation"), F.get(kinds, (F.col("item_id") % 7).cast("int")).alias("kind"), F.when(F.col("k") == 1, F.lit("só")).alias("note"), (F.col("item_id") * 2 + F.col("k")).alias("place"))


GLOSSARY_SQL = "with b as (select item_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) w from benchmark), g as (select array_to_string(w[1:3], ' ') term, item_id, 0 k, null::varchar note from b where len(w) >= 3 union all select w[1], item_id, 1, 'só' from b where len(w) >= 3)"
_KIND_SQL = "case item_id % 7 " + " ".join(f"when {k} then '{name}'" for k, name in enumerate(glossary.KINDS)) + " end"


@query("glossary_blocks", GLOSSARY_SQL + f" select {_KIND_SQL} as kind, count(*) as n, concat('[', {_KIND_SQL}, ']', chr(10), string_agg(concat('  ', term, ' = ', upper(term), coalesce('  (' || note || ')', '')), chr(10) order by item_id * 2 + k)) as block from g where item_id % 7 < 4 group by item_id % 7, 1")
def glossary_blocks(s, d):
    """The prompt's blocks of the core kinds."""
    return glossary.blocks(_glossary(s, d)).select("kind", "n", "block")


_TERMS_SQL = GLOSSARY_SQL.replace("with b as", "with recursive b as") + """, t as (select term, len(string_split(term, ' ')) n from g group by 1), d as (select doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) w from documents), p as (select doc_id, w, unnest(range(1, len(w) + 1)) i from d),
 f as (select doc_id, i, n, term from p join t on n = 1 and term = w[i] union all select doc_id, i, n, term from p join t on n = 3 and term = array_to_string(w[i:i + 2], ' ')), x as (select * from f qualify row_number() over (partition by doc_id, i order by n desc) = 1),
 l as (select x.doc_id, x.i, x.n, x.term, y.i following from x asof left join x y on x.doc_id = y.doc_id and x.i + x.n <= y.i),
 r as (select * from l where i = (select min(i) from x where x.doc_id = l.doc_id) union all select l.* from r join l on l.doc_id = r.doc_id and l.i = r.following)"""


@query("glossary_terms", _TERMS_SQL + " select doc_id, term, count(*) as n from r group by 1, 2")
def glossary_terms(s, d):
    """How often each term stands in each document, from left to right, the longest first."""
    found = glossary.met(table(s, d, "documents").select("doc_id", "text"), _glossary(s, d))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("page_requests", ARTICLES_SQL + """, r as (select event_id, cast(event_id % 40 as bigint) number, case event_type when 'view' then 'en' when 'click' then 'de' when 'error' then 'pt' end category from events), n as (select category_slug c, count(*) n from pub group by 1 union all select null, count(*) from pub)
 select event_id, cast(greatest(ceil(coalesce(n, 0) / 12.0), 1) as bigint) as pages, number = 1 or number between 1 and greatest(ceil(coalesce(n, 0) / 12.0), 1) as valid from r left join n on category is not distinct from c""")
def page_requests(s, d):
    """Whether the pages that were asked for are there."""
    kind = F.col("event_type")
    category = F.when(kind == "view", "en").when(kind == "click", "de").when(kind == "error", "pt")
    asked = table(s, d, "events").select("event_id", (F.col("event_id") % 40).alias("number"), category.alias("category"))
    return reads.valid_pages(articles(s, d), asked).select("event_id", "pages", "valid")


@query("error_kinds", """with s as (select doc_id, text, case doc_id % 8 when 0 then null when 1 then 200 when 2 then 401 when 3 then 402 when 4 then 429 when 5 then 400 when 6 then 503 else 403 end st from documents)
 select doc_id, case when st is null then 'rede' when st in (401, 403) then 'desativado' when st in (402, 429) then 'quota' when st >= 400 then 'indisponivel' end as kind, case when st is null then concat('TimeoutError: ', doc_id) when st >= 400 then concat('HTTP ', st, ': ', left(text, 300)) end as message from s""")
def error_kinds(s, d):
    """What failed calls mean, with what is recorded of their answers."""
    i = F.col("doc_id")
    status = F.element_at(F.array(*(F.lit(x) for x in (None, 200, 401, 402, 429, 400, 503, 403))), (i % 8 + 1).cast("int"))
    e = F.col("e")
    rows = table(s, d, "documents").withColumn("e", adapt.provider_error(status, F.col("text"), F.concat(F.lit("TimeoutError: "), i.cast("string"))))
    return rows.select("doc_id", e["kind"].alias("kind"), e["message"].alias("message"))


_JOBS = "case event_type when 'view' then 'ingest' when 'click' then 'adapt' when 'purchase' then 'calendar' end"
_TIMES = " union all ".join(f"select '{t.name}' trigger_, m, lead(m, 1, 1440 + {t.times()[0]}) over (order by m) next from unnest({t.times()}) u(m)" for t in schedule.TRIGGERS)


@query("schedule_misses", f"""with r as (select {_JOBS} job, ts from events where event_type in ('view', 'click', 'purchase')), d as (select distinct date_trunc('day', ts)::timestamp d from events), t as ({_TIMES}),
 f as (select trigger_, d + m * interval 1 minute due, d + next * interval 1 minute until from d, t) select trigger_ as trigger, strftime(due, '%Y-%m-%d %H:%M') as due, count(ts) as runs from f left join r on job = trigger_ and ts >= due and ts < until group by 1, 2 having count(ts) <> 1""")
def schedule_misses(s, d):
    """Firings that no run answered, or several."""
    events, kind = table(s, d, "events"), F.col("event_type")
    job = F.when(kind == "view", "ingest").when(kind == "click", "adapt").when(kind == "purchase", "calendar")
    days = events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).distinct()
    told = schedule.answered(events.select(job.alias("job"), F.col("ts").cast("timestamp_ntz").alias("ts")), days, "job", "ts")
    return told.filter("runs <> 1").select("trigger", F.date_format("due", "yyyy-MM-dd HH:mm").alias("due"), "runs")
