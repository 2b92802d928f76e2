"""Queries of the editorial side: rules, answers, divergences, states. Rows come from the tables, with parts planted by id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions import answers, divergences, text
from .plans import adapt, classify, editorial, rules
from .registry import query, sql_list
from .sources.tables import table

WORDS = "regexp_extract_all(lower({0}), '([\\p{{L}}\\p{{N}}'']+)', 1)"


def _by(k: int, *values: str | None) -> Column:
    """values[doc_id % k], the last one for the rest."""
    out = F.lit(values[-1]).cast("string")
    for i in range(len(values) - 2, -1, -1):
        out = F.when(F.col("doc_id") % k == i, F.lit(values[i]).cast("string")).otherwise(out)
    return out


def _sql_by(k: int, *values: str | None, key: str = "doc_id") -> str:
    held = ["null::varchar" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"case {key} % {k} " + " ".join(f"when {i} then {v}" for i, v in enumerate(held[:-1])) + f" else {held[-1]} end"


PLANTED = (10, "As an AI, ", "O salmo responsorial. ", "The Holy See. ", "Os 12 bispos e 1,234 fiéis, 777 deles. ", "Tempo comum e 21 dias. ", "")
ORIGIN = (10, "", "the responsorial psalm; ", "", "twelve bishops, 1.234 people; ", "twenty-one days; ", "")
URLS = (6, "https://www.ewtnnews.com/a", "https://ewtnnews.com.evil.example/a", "ftp://ewtnnews.com/a", "", "https://signofthecrossmedia.com/b", "sem endereço")
SOURCES = (3, "ewtn", "sotc", None)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """A document's text as the rewriting of the next document's, with parts planted in both."""
    docs = table(s, d, "documents")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(_by_other(ORIGIN), F.col("text")).alias("original"), F.col("n_chars").alias("source_length"))
    i = F.col("doc_id")
    consistent, found = i % 5 == 1, F.when(i % 5 == 2, F.array(F.lit("data trocada"), F.lit(" "))).when(i % 5 == 4, F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))
    verdict = F.when(i % 5 != 0, F.struct(consistent.alias("consistent"), found.alias("divergences")))
    return docs.join(other.hint("merge"), "doc_id").select(  # both sides hold texts: dealt by id at any size
        "doc_id", F.concat(_by(*PLANTED), F.col("text")).alias("body"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.substring("text", 1, 200).alias("dek"), "original", "source_length",
        F.when(i % 4 != 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), _by(*SOURCES).alias("source"), F.when(i % 8 != 0, F.col("source")).alias("source_name"), _by(*URLS).alias("source_url"), verdict.alias("verdict"),
    )


def _by_other(values: tuple) -> Column:
    """By the id of the document before."""
    k, *texts = values
    out = F.lit(texts[-1])
    for i in range(len(texts) - 2, -1, -1):
        out = F.when((F.col("doc_id") - 1) % k == i, F.lit(texts[i])).otherwise(out)
    return out


PAIRS_SQL = f"""with pairs as (select a.doc_id, concat({_sql_by(*PLANTED, key='a.doc_id')}, a.text) body, split_part(a.text, '.', 1) title, left(a.text, 200) dek, concat({_sql_by(*ORIGIN, key='a.doc_id')}, b.text) original, b.n_chars source_length,
 case when a.doc_id % 4 <> 0 then 2 else 0 end n_tags, {_sql_by(*SOURCES, key='a.doc_id')} source, case when a.doc_id % 8 <> 0 then a.source end source_name, {_sql_by(*URLS, key='a.doc_id')} source_url from documents a join documents b on b.doc_id = a.doc_id + 1),
 t as (select *, concat_ws(chr(10) || chr(10), title, dek, body) whole, trim(body, ' ' || chr(10) || chr(9) || chr(13)) clean from pairs)"""
_CLEAN = "regexp_replace(regexp_replace({0}, '(?m)^\\s{{0,3}}\\d{{1,3}}[.)]\\s+', '', 'g'), '\\]\\([^)]*\\)', ']', 'g')"
_FOUND = "list_distinct(list_transform(regexp_extract_all(" + _CLEAN + ", '(\\d{{1,3}}(?:[.,\\x{{a0}}\\x{{202f}} ]\\d{{3}})+(?:[.,]\\d+)?|\\d+(?:[.,]\\d+)?)', 1), lambda x: case when ltrim(regexp_replace(x, '[.,\\x{{a0}}\\x{{202f}} ]', '', 'g'), '0') = '' then '0' else ltrim(regexp_replace(x, '[.,\\x{{a0}}\\x{{202f}} ]', '', 'g'), '0') end))"


def _holds(col: str, term: str) -> str:
    return f"regexp_matches({col}, '(?i)(^|[^\\p{{L}}\\p{{N}}])" + term.replace("'", "''").replace(".", "\\.") + "($|[^\\p{L}\\p{N}])')"


_SAID = "list_filter([" + ", ".join(f"case when {_holds('original', w)} then '{n}' end" for w, n in editorial.NUMERALS.items()) + "], lambda x: x is not null)"
_VALUES = "map {" + ", ".join(f"'{w}': {n}" for w, n in editorial.NUMERALS.items()) + "}"
_SUMS = f"list_transform(regexp_extract_all(lower(original), '\\b((?:{'|'.join(editorial.TENS)})[- ](?:{'|'.join(editorial.ONES)}))\\b', 1), lambda x: cast({_VALUES}[regexp_split_to_array(x, '[- ]')[1]] + {_VALUES}[regexp_split_to_array(x, '[- ]')[2]] as varchar))"
_LEFT = f"list_filter({_FOUND.format('whole')}, lambda x: not list_contains(list_concat({_FOUND.format('original')}, {_SAID}, {_SUMS}), x))"
_REFUSED = "list_filter([" + ", ".join(f"case when regexp_matches(whole, '{p.replace(chr(39), chr(39) * 2)}') then '{n.replace(chr(39), chr(39) * 2)}' end" for p, n in editorial.REFUSALS) + "], lambda x: x is not null)"
_VETOED = "list_filter([" + ", ".join(f"case when contains(strip_accents(lower(whole)), strip_accents('{t}')) and not (" + " or ".join(f"contains(lower(original), '{o}')" for o in origins) + f") then '{t}' end" for t, origins in editorial.VETOED) + "], lambda x: x is not null)"
_ENGLISH = "list_filter([" + ", ".join(f"case when {_holds('whole', t)} then '{t.replace(chr(39), chr(39) * 2)}' end" for t in editorial.TRANSLATE) + "], lambda x: x is not null)"
SIGNALS_SQL = PAIRS_SQL + f", g as (select *, {_LEFT} numbers_left, {_REFUSED} refusals, {_VETOED} vetoed, {_ENGLISH} english_terms from t)"


@query("editorial_signals", SIGNALS_SQL + " select doc_id, array_to_string(list_sort(numbers_left), ',') as numbers_left, array_to_string(refusals, ',') as refusals, array_to_string(vetoed, ',') as vetoed, array_to_string(english_terms, ',') as english_terms from g")
def editorial_signals(s, d):
    """Numbers that the original doesn't allow, refusal labels, vetoed terms without absolution, terms left in English."""
    join = lambda c: F.array_join(c, ",")
    return editorial.facts(_pairs(s, d)).select("doc_id", join(F.array_sort("__left")).alias("numbers_left"), join("__refusals").alias("refusals"), join(F.array_compact(editorial.rite_rule())).alias("vetoed"), join("__terms").alias("english_terms"))


_HOSTS = " or ".join(f"(source = '{src}' and (host = '{h}' or ends_with(host, '.{h}')))" for src, hosts in editorial.HOSTS.items() for h in hosts)
_STOP = "len(list_filter(w, lambda x: list_contains({0}, x)))"
VERDICT_SQL = SIGNALS_SQL + f""", w as (select *, {WORDS.format('whole')} w, len(list_filter(regexp_split_to_array(clean, '\\n{{2,}}'), lambda x: trim(x) <> '')) par, trim(coalesce(source_url, '')) url,
 lower(regexp_extract(trim(coalesce(source_url, '')), '^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]', 1)) scheme, lower(regexp_extract(trim(coalesce(source_url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) host,
 case when length(trim(original)) > 0 then least(source_length, length(trim(original, ' ' || chr(10) || chr(9) || chr(13)))) else source_length end base from g),
 x as (select *, {_STOP.format(sql_list(dims.ENGLISH))} en, {_STOP.format(sql_list(dims.PORTUGUESE))} pt from w),
 e as (select doc_id, (clean = '' or length(clean) not between 700 and 3200 or par not between 3 and 6 or length(trim(title)) not between 18 and 130 or length(trim(dek, ' ' || chr(10))) not between 40 and 280 or n_tags not between 2 and 6) c1,
 (source_length <= 0 or length(clean)::double / base > 0.6 or length(clean)::double / base < 0.18) c2,
 (trim(coalesce(source_name, '')) = '' or url = '' or scheme = '' or scheme not in ('http', 'https') or not coalesce({_HOSTS}, false)) c3,
 len(numbers_left) > 0 c4, doc_id % 5 <> 1 c5, (case when en + pt = 0 then 1.0 else en::double / (en + pt) end > 0.35 or len(regexp_extract_all(whole, '{dims.DIACRITICS}'))::double / greatest(length(whole), 1) < 0.008) c6,
 len(refusals) > 0 c7, len(vetoed) > 0 c8, len(english_terms) > 0 c9 from x),
 f as (select doc_id, list_filter([case when c1 then 'comprimento' end, case when c2 then 'proporcao' end, case when c3 then 'atribuicao' end, case when c4 then 'numeros' end, case when c5 then 'verificacao_factual' end, case when c6 then 'idioma' end,
 case when c7 then 'recusa_do_modelo' end, case when c8 then 'rito_1962' end, case when c9 then 'glossario' end], lambda y: y is not null) failed from e)"""


@query("guardrail_verdict", VERDICT_SQL + " select doc_id, array_to_string(failed, ',') as failed_rules, len(failed) = 0 as passed from f")
def guardrail_verdict(s, d):
    """All nine rules."""
    return rules.judge(editorial.facts(_pairs(s, d)), editorial.NINE_RULES).select("doc_id", F.array_join("failed_rules", ",").alias("failed_rules"), "passed")


@query("retry_gate", VERDICT_SQL.replace(" doc_id % 5 <> 1 c5", " false c5").replace("len(numbers_left) > 0 c4", "false c4") + " select doc_id, array_to_string(list_filter(failed, lambda x: x in ('comprimento', 'proporcao', 'recusa_do_modelo')), ',') as failed_rules, len(list_filter(failed, lambda x: x in ('comprimento', 'proporcao', 'recusa_do_modelo'))) > 0 and not list_contains(failed, 'recusa_do_modelo') as again from f")
def retry_gate(s, d):
    """Answers that failed by their length alone."""
    three = [r for r in editorial.NINE_RULES if r[0] in ("comprimento", "proporcao", "recusa_do_modelo")]
    return rules.judge(editorial.facts(_pairs(s, d)), three).select("doc_id", F.array_join("failed_rules", ",").alias("failed_rules"), rules.too_long_alone(F.col("failed_rules")).alias("again"))


_HEAD, _BODY = "regexp_replace(split_part(text, '.', 1), '[^A-Za-z ]', '', 'g')", "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
DRAFTS_SQL = f"with c as (select doc_id, trim(concat('T ', trim({_HEAD}))) t, trim(concat('B ', trim({_BODY}))) b from documents)"


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Model answers: blocks after closed reasoning, decorated blocks, JSON, fenced JSON, an open reasoning block."""
    docs = table(s, d, "documents")
    t = F.concat(F.lit("T "), F.trim(F.regexp_replace(F.split_part("text", F.lit("."), F.lit(1)), "[^A-Za-z ]", "")))
    b = F.concat(F.lit("B "), F.trim(F.regexp_replace(F.col("text"), "[^A-Za-z ]", "")))
    made = F.to_json(F.struct(t.alias("titulo"), F.lit("Linha").alias("dek"), b.alias("corpo_md"), F.lit("Santos").alias("categoria"), F.array(F.lit("#Um"), F.lit("dois")).alias("tags")))
    blocks = F.concat(F.lit("TITULO: "), t, F.lit("\nDEK: Linha\nCATEGORIA: Santos\nTAGS: #Um, dois; um\nCORPO:\n"), b)
    kinds = (F.concat(F.lit("<think>hm\nTITULO: x</think>"), blocks), F.replace(F.replace(blocks, F.lit("TITULO:"), F.lit("**Headline:")), F.lit("CORPO:"), F.lit("## Texto:")), made, F.concat(F.lit("```json\n"), made, F.lit("\n```")), F.concat(F.lit("<think>"), blocks))
    answer = kinds[4]
    for k in range(3, -1, -1):
        answer = F.when(F.col("doc_id") % 5 == k, kinds[k]).otherwise(answer)
    return docs.select("doc_id", answer.alias("answer"))


@query("draft_reading", DRAFTS_SQL + " select doc_id, case when doc_id % 5 < 4 then t end as title, case when doc_id % 5 < 4 then 'Linha' end as dek, case when doc_id % 5 < 4 then 'santos' end as category, case when doc_id % 5 < 4 then 'um,dois' end as tags, case when doc_id % 5 < 4 then b end as body from c")
def draft_reading(s, d):
    """Drafts read from answers; null where nothing can be read."""
    r = F.col("r")
    return _answers(s, d).withColumn("r", answers.read_draft(F.col("answer"))).select("doc_id", r["title"].alias("title"), r["dek"].alias("dek"), r["category"].alias("category"), F.array_join(r["tags"], ",").alias("tags"), r["body"].alias("body"))


VERDICTS = (
    (7, "VEREDITO: CONSISTENTE\nDIVERGENCIAS:", '{ "VEREDITO": "CONSISTENTE", "DIVERGENCIAS": [] }', "**Veredito:** x\nVEREDITO: DIVERGENTE\nDIVERGÊNCIAS:\n- não menciona o nome do bispo\n- curta", "VEREDITO: DIVERGENTE\nDIVERGENCIAS:\n- o texto diz 12 e o original 15\n- formato de data diferente",
     '```json\n{"consistente": false, "divergencia": ["o texto diz Roma", " "]}\n```', "sem veredito legível", '{"veredito": "divergente", "divergencias": ["omite a data"]}'),
    (True, True, True, False, False, None, True),
    ("", "", "", "o texto diz 12 e o original 15", "o texto diz Roma", None, ""),
)


@query("verdict_reading", f"select doc_id, case when doc_id % 7 in (0, 1, 2, 6) then true when doc_id % 7 in (3, 4) then false end as consistent, {_sql_by(7, *VERDICTS[2])} as divergences from documents")
def verdict_reading(s, d):
    """Verdicts from lines or JSON in any letter case; complaints about omissions and translation don't count."""
    r = F.col("r")
    rows = table(s, d, "documents").withColumn("r", answers.read_verdict(_by(*VERDICTS[0])))
    return rows.select("doc_id", r["consistent"].alias("consistent"), F.array_join(r["divergences"], "|").alias("divergences"))


CLAIMS = (
    (8, "“a freira Leticia Ugboaja” — no original dizia “Sister Leticia Ugboaja”", "“Guerra da Independência” — o original dizia “the Civil War”", "\"Papa Leão XIV, 1.234 fiéis em 4 de agosto\" e \"Pope Leo XIV: 1,234 faithful on Aug. 4\"", "“em 4 de agosto” — no original era “on September 4”", "“Papa Francisco” — no original era “Pope Leo XIV”",
     "“não aprovou Roma” — o original diz “approved Roma”", "sem par citado", "“João e 12 bispos” — original traz “John and 13 bishops”"),
    (True, False, True, False, False, False, False, False),
)


@query("structural_noise", "select doc_id, doc_id % 8 in (0, 2) as noise, " + _sql_by(8, "leticia,ugboaja", "guerra,independencia", "leao,xiv", "", "francisco", "roma", "", "joao") + " as names, " + _sql_by(8, "", "", "1234,4", "4", "", "", "", "12") + " as numbers, case when doc_id % 8 in (2, 3) then '8' else '' end as months from documents")
def structural_noise(s, d):
    """Divergences whose quoted pair differs in wording alone, with the adapted side's hard tokens."""
    join = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    rows = divergences.with_noise(table(s, d, "documents").withColumn("claim", _by(*CLAIMS[0])), "claim")
    return rows.select("doc_id", "noise", join(F.col("adapted.names")).alias("names"), join(F.col("adapted.numbers")).alias("numbers"), join(F.transform("adapted.months", lambda m: m.cast("string"))).alias("months"))


@query("isolated_rules", """with r as (select doc_id, case when doc_id % 97 = 0 then ['densidade: a própria checagem falhou (division by zero) — reprovado por precaução.'] when n_chars // (doc_id % 97) < 20 then [concat('densidade: ', n_chars // (doc_id % 97))] else [] end a,
 list_transform(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: length(w) > 16), lambda w: concat('palavras: longa demais ', w)) b from documents), e as (select doc_id, list_concat(a, b) e, len(a) > 0 d, len(b) > 0 p from r)
 select doc_id, array_to_string(list_filter([case when d then 'densidade' end, case when p then 'palavras' end], lambda x: x is not null), ',') as failed_rules,
 array_to_string(list_concat(list_transform(list_slice(e, 1, 20), lambda x: case when length(x) > 500 then concat(left(x, 500), '…') else x end), case when len(e) > 20 then [concat('(+', len(e) - 20, ' erro(s) omitido(s))')] else [] end), chr(10)) as errors from e""")
def isolated_rules(s, d):
    """Two rules in Python, one of which divides by zero on some rows: these fail with that as the reason, and all errors are recorded up to their limits."""

    def density(ids: list[int], sizes: list[int]) -> list[list[str]]:
        return [[str(int(n / (i % 97)))] if n / (i % 97) < 20 else [] for i, n in zip(ids, sizes, strict=True)]

    def long_words(texts: list[str]) -> list[list[str]]:
        return [[f"longa demais {w}" for w in re.split(r"[ \n]+", t or "") if len(w) > 16] for t in texts]

    pairs = table(s, d, "documents").select("doc_id", "n_chars", "text", *(F.lit("").alias(c) for c in ("title", "dek", "body", "original")))
    told = rules.judge(pairs, (), (rules.RowRule("densidade", ("doc_id", "n_chars"), density), rules.RowRule("palavras", ("text",), long_words)))
    return told.select("doc_id", F.array_join("failed_rules", ",").alias("failed_rules"), F.array_join("errors", "\n").alias("errors"))


@query("numbered_divergences", "select doc_id, i::int as position, n::int as total, concat('divergence ', i, '/', n, ': ', w) as line from (select doc_id, unnest(range(1, len(string_split(text, ' ')) + 1)) i, len(string_split(text, ' ')) n, unnest(string_split(text, ' ')) w from documents)")
def numbered_divergences(s, d):
    """Positions of an array's items with their number."""
    rows = table(s, d, "documents").withColumn("w", F.split("text", " ", -1))
    rows = rows.select("doc_id", F.size("w").alias("total"), F.posexplode("w").alias("i", "said"))
    return rows.select("doc_id", (F.col("i") + 1).alias("position"), "total", F.concat(F.lit("divergence "), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(": "), F.col("said")).alias("line"))


def _attempts(s: SparkSession, d: str) -> DataFrame:
    """Two attempts of every document: ids decide what went wrong."""
    i, n = F.col("doc_id"), F.col("attempt")
    rows = table(s, d, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).filter((n == 1) | (i % 9 == 5))
    failed = F.when(i % 9 == 4, F.array(F.lit("numeros"))).when((i % 9 == 5) & (n == 1), F.array(F.lit("comprimento"))).when((i % 9 == 5) & (i % 2 == 0), F.array(F.lit("proporcao"))).otherwise(F.array().cast("array<string>"))
    status = F.when(i % 9 == 1, 429).when(i % 9 == 2, 401).when(i % 9 == 6, 400)
    return rows.select(
        "doc_id", "attempt", (i % 9 != 0).alias("ready"), adapt.error_kind(F.coalesce(status, F.lit(0))).alias("answer_error"), F.when(i % 9 == 3, adapt.error_kind(F.lit(None).cast("int"))).alias("check_error"), (i % 9 != 7).alias("verdict_read"), failed.alias("failed_rules"),
        F.when(i % 4 != 0, i).alias("tokens_in"), F.when(i % 3 != 0, n).cast("long").alias("tokens_out"),
    )


STATES_SQL = """with s as (select doc_id, case doc_id % 9 when 0 then 'failed_validation' when 1 then 'draft' when 2 then 'draft' when 3 then 'draft' when 4 then 'failed_validation' when 5 then case when doc_id % 2 = 0 then 'failed_validation' else 'published' end
 when 6 then 'draft' when 7 then 'draft' else 'published' end status, case doc_id % 9 when 0 then 'preflight' when 1 then 'answer_error' when 2 then 'answer_error' when 3 then 'deferred' when 4 then 'rejected' when 5 then case when doc_id % 2 = 0 then 'rejected' else 'published' end
 when 6 then 'answer_error' when 7 then 'deferred' else 'published' end step, case when doc_id % 9 = 5 then 2 else 1 end attempts, case when doc_id % 4 <> 0 then doc_id * case when doc_id % 9 = 5 then 2 else 1 end end tokens_in, case when doc_id % 3 <> 0 then case when doc_id % 9 = 5 then 3 else 1 end end tokens_out from documents)"""


@query("adapt_states", STATES_SQL + " select doc_id, status, step, attempts::bigint as attempts, tokens_in::bigint as tokens_in, tokens_out::bigint as tokens_out from s")
def adapt_states(s, d):
    return adapt.final_states(_attempts(s, d), "doc_id")


@query("adapt_totals", STATES_SQL + " select coalesce(sum(tokens_in), 0)::bigint as tokens_in, coalesce(sum(tokens_out), 0)::bigint as tokens_out, count(*) filter (status = 'published') as published, count(*) filter (status = 'failed_validation') as failed_validation, count(*) filter (status = 'draft') as draft from s")
def adapt_totals(s, d):
    return adapt.token_totals(adapt.final_states(_attempts(s, d), "doc_id"))


BREAKER_SQL = """with e as (select event_id, user_id, {0} batch, ts, case when event_type = 'error' then case when event_id % 50 = 0 then 'quota' else 'rede' end end error from events where {1}),
 i as (select *, sum(case when error is null then 1 else 0 end) over (partition by batch order by ts, event_id rows unbounded preceding) island from e),
 k as (select *, sum(case when error is null then 0 else 1 end) over (partition by batch, island order by ts, event_id rows unbounded preceding) streak from i),
 b as (select *, coalesce(sum(case when error in ('quota', 'desativado') or streak >= 3 then 1 else 0 end) over (partition by batch order by ts, event_id rows between unbounded preceding and 1 preceding), 0) before from k)"""


def _items(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 50 == 0, "quota").otherwise("rede"))
    return table(s, d, "events").select("event_id", "user_id", "ts", kind.alias("error"))


@query("batch_breaker", BREAKER_SQL.format("user_id", "true") + " select event_id, error, before = 0 as processed from b")
def batch_breaker(s, d):
    """Items that a batch gets to before an error or three in a row end it."""
    return adapt.breaker(_items(s, d), "user_id", ("ts", "event_id")).select("event_id", "error", "processed")


@query("batch_deferred", BREAKER_SQL.format("event_id // 64 % 3", "true") + " select batch, count(*) as seen, count(*) filter (before = 0) as processed, count(*) filter (before > 0) as deferred, arg_max(error, row(ts, event_id)) filter (before = 0 and (error in ('quota', 'desativado') or streak >= 3)) as aborted_by from b group by 1")
def batch_deferred(s, d):
    """Three batches of all events: what each got to, what it left, and the error that ended it."""
    items = _items(s, d).withColumn("batch", F.floor(F.col("event_id") / 64) % 3)
    return adapt.deferred(items, "batch", ("ts", "event_id"))


@query("category_refined", "select doc_id, case when doc_id % 2 = 0 and doc_id % 3 < 2 then case doc_id % 3 when 0 then 'santos' else 'brasil' end when doc_id % 2 = 0 then 'mundo' else 'liturgia' end as category from documents")
def category_refined(s, d):
    """A suggested category replaces the default alone, and only if it is one."""
    now, said = F.when(F.col("doc_id") % 2 == 0, "mundo").otherwise("liturgia"), _by(3, "santos", "brasil", "nenhuma")
    return table(s, d, "documents").select("doc_id", classify.refined(now, said).alias("category"))


@query("text_measures", "select doc_id, least(greatest(cast(floor(n_chars * 0.4 + 0.5) as bigint), 700), 3000) as least_chars, least(greatest(cast(floor(n_chars * 0.5 + 0.5) as bigint), least(greatest(cast(floor(n_chars * 0.4 + 0.5) as bigint), 700), 3000) + 150), 3200) as most_chars, cast(floor(least(greatest(cast(floor(n_chars * 0.4 + 0.5) as bigint), 700), 3000) / 6.3 + 0.5) as bigint) as least_words from documents")
def text_measures(s, d):
    """The characters and words that an adaptation of each text should have."""
    aim = text.target_chars(F.col("n_chars"))
    return table(s, d, "documents").select("doc_id", aim["min"].alias("least_chars"), aim["max"].alias("most_chars"), text.target_words(aim["min"]).alias("least_words"))
