"""The guard-rails that look at origin, facts and wording: attribution, numbers with numerals, verdict, refusals, rite, glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import MAX_ENGLISH, MIN_DIACRITICS
from ..functions.text import diacritic_density, english_share, fold, stop_counts, unaccented
from .rules import length_rule, prepared, ratio_rule

# Hosts by source.
HOSTS = {"ewtn": ("ewtnnews.com",), "sotc": ("signofthecrossmedia.com",)}
# Signs that a model speaks for itself or leaks its answer's frame, with their labels.
REFUSALS = (
    (r"(?i)\bI(?:'|’)?m sorry\b", "I'm sorry"), (r"(?i)\bI am sorry\b", "I am sorry"), (r"(?i)\bI apologi[sz]e\b", "I apologize"), (r"(?i)\bas an AI\b", "As an AI"), (r"(?i)\bas a language model\b", "as a language model"),
    (r"(?i)\bI cannot\b", "I cannot"), (r"(?i)\bI can(?:'|’)?t\b", "I can't"), (r"(?i)\bI(?:'|’)?m unable\b", "I'm unable"), (r"(?i)\bI do not have\b", "I do not have"), (r"(?i)\bhere(?:'|’)?s the\b", "Here's the"),
    (r"(?i)\bhere is the (?:adapted|translated|article|rewritten)\b", "Here is the ..."), (r"(?i)\bsure[,!]\s", "Sure, ..."), (r"(?i)como (?:uma? )?(?:IA|inteligência artificial)\b", "como uma IA"), (r"(?i)modelo de linguagem", "modelo de linguagem"),
    (r"(?i)(?:desculpe|sinto muito)[,.]?\s+(?:mas\s+)?não posso", "desculpe, não posso"), (r"(?i)não posso (?:ajudar|atender|realizar|fazer isso)", "não posso ajudar"), (r"(?i)\bclaro[,!]\s+(?:aqui|segue)", "Claro, aqui está"), (r"```", "cerca de código (```)"),
    (r"(?i)<\|[a-z_]+\|>", "token especial do modelo"), (r"(?im)^\s*(?:assistant|system|user)\s*:", "rótulo de turno de chat"), (r'(?i)"corpo_md"\s*:', "JSON da resposta vazou para o corpo"),
)
# Terms that the 1962 rite doesn't know, with the English ones that allow them.
VETOED = (
    ("salmo responsorial", ("responsorial psalm",)), ("primeira leitura", ("first reading",)), ("segunda leitura", ("second reading",)), ("oração dos fiéis", ("prayer of the faithful", "universal prayer")),
    ("tempo comum", ("ordinary time",)), ("memória obrigatória", ("obligatory memorial",)), ("memória facultativa", ("optional memorial",)), ("unção dos enfermos", ("anointing of the sick",)),
)
# English terms that must not stay in a translation.
TRANSLATE = (
    "Holy See", "Apostolic See", "Dicastery", "Roman Curia", "Episcopal Conference", "Bishops' Conference", "College of Cardinals", "His Holiness", "His Eminence", "His Excellency", "Holy Father", "cause for sainthood", "cause for beatification",
    "Servant of God", "heroic virtues", "decree of martyrdom", "approved miracle", "Dicastery for the Causes of Saints", "Epistle", "Traditional Latin Mass", "Extraordinary Form", "Ember Days", "Sunday after Pentecost", "St. Therese of Lisieux",
    "Blessed Virgin Mary", "Our Lady of Guadalupe", "Our Lady of Fatima", "Our Lady of Aparecida", "Our Lady of Sorrows", "apostolic exhortation", "apostolic constitution", "apostolic letter", "Code of Canon Law", "Catechism of the Catholic Church",
    "Second Vatican Council", "Council of Trent", "Deposit of Faith", "Real Presence", "Blessed Sacrament", "Sacrament of Penance", "plenary indulgence", "Holy Year", "Stations of the Cross", "Holy Week", "Ash Wednesday", "Good Friday",
    "Easter Vigil", "Sacred Heart", "Immaculate Heart", "Precious Blood", "Immaculate Conception",
)
# English numerals.
NUMERALS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000, "dozen": 12,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
TENS, ONES = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"), ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _empty() -> Column:
    return F.array().cast("array<string>")


def _text() -> Column:
    """Title, dek and body, as rules.prepared has them."""
    return F.col("__whole")


def holds_term(text: Column, term: str, low: Column | None = None) -> Column:
    """Whether the term stands in the text as whole words, in any case; low: the text in lower case."""
    return F.contains(F.lower(text) if low is None else low, F.lit(term.lower())) & text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{N}}])")


def content_numbers(text: Column) -> Column:
    """The patterns of list markers, link targets and numbers. Distinct numbers, grouped ones too, without separators and leading zeros; list markers and link targets don't count."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s{0,3}\d{1,3}[.)]\s+", ""), r"\]\([^)]*\)", "]")
    found = F.regexp_extract_all(clean, F.lit(r"(\d{1,3}(?:[.,\x{a0}\x{202f} ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[.,\x{a0}\x{202f} ]", ""), "^0+(?=[0-9])", "")))


def allowed_numbers(original: Column, low: Column | None = None) -> Column:
    """Numbers of the original, its English numerals (whole words, found in one pass) and compounds such as twenty-one."""
    low = F.lower(original) if low is None else low
    value = F.create_map(*(x for w, n in NUMERALS.items() for x in (F.lit(w), F.lit(n))))
    words = F.array_intersect(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array(*map(F.lit, NUMERALS)))
    pairs = F.regexp_extract_all(low, F.lit(rf"\b((?:{'|'.join(TENS)})[- ](?:{'|'.join(ONES)}))\b"), F.lit(1))
    sums = F.transform(pairs, lambda p: (value[F.get(F.split(p, "[- ]"), F.lit(0))] + value[F.get(F.split(p, "[- ]"), F.lit(1))]).cast("string"))
    return F.array_distinct(F.concat(content_numbers(original), F.transform(words, lambda w: value[w].cast("string")), sums))


def facts(pairs: DataFrame) -> DataFrame:
    """rules.prepared, and what the rules below find in the texts, each looked for once a row: numbers left, counts of function words, refusals, English terms, the text without accents."""
    made = prepared(pairs)
    made = made.withColumns({"__numbers": content_numbers(_text()), "__allowed": allowed_numbers(F.coalesce("original", F.lit("")), F.col("__original_low")), "__stop": stop_counts(_text()), "__refusals": refusal_labels(_text(), F.col("__low")), "__terms": english_terms(_text(), F.col("__low")), "__plain": unaccented(F.col("__low"))})
    return made.withColumn("__left", F.array_except("__numbers", "__allowed"))


def attribution_rule() -> Column:
    """Columns source, source_name, source_url: both filled in, an absolute http(s) address on one of the source's hosts."""
    url = F.trim(F.coalesce("source_url", F.lit("")))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    owned = F.lit(False)
    for source, hosts in HOSTS.items():
        for h in hosts:
            owned = owned | ((F.col("source") == source) & ((host == h) | host.endswith(f".{h}")))
    name = F.when(F.trim(F.coalesce("source_name", F.lit(""))) == "", "source name empty")
    rest = F.array(F.when(~scheme.isin("http", "https"), "scheme"), F.when(~F.coalesce(owned, F.lit(False)), "host"))
    return F.array_append(F.when(url == "", F.array(F.lit("address empty"))).when(scheme == "", F.array(F.lit("address not absolute"))).otherwise(rest), name)


def number_rule() -> Column:
    return F.when(F.size("__left") > 0, F.array(F.array_join(F.slice("__left", 1, 10), ", "))).otherwise(_empty())


def verdict_rule() -> Column:
    """Column verdict, struct(consistent, divergences): none fails, each divergence up to six is an error, an unexplained no is one."""
    found = F.filter(F.transform(F.slice(F.col("verdict.divergences"), 1, 6), lambda d: F.trim(d)), lambda d: d != "")
    return (
        F.when(F.col("verdict").isNull(), F.array(F.lit("checagem factual não foi produzida")))
        .when(F.coalesce(F.size("verdict.divergences"), F.lit(0)) > 0, found)
        .when(~F.coalesce("verdict.consistent", F.lit(False)), F.array(F.lit("unexplained")))
        .otherwise(_empty())
    )


def language_rule() -> Column:
    return F.array(F.when(english_share(F.col("__stop")) > MAX_ENGLISH, "English"), F.when(diacritic_density(_text()) < MIN_DIACRITICS, "few diacritics"))


#: What each refusal's pattern can't do without one of, in lower case, in their order; texts without them aren't matched.
FRAGMENTS = (
    ("m sorry",), ("i am sorry",), ("i apologi",), ("as an ai",), ("as a language model",), ("i cannot",), ("i cant", "i can't", "i can’t"), ("m unable",), ("i do not have",), ("heres the", "here's the", "here’s the"), ("here is the",),
    ("sure,", "sure!"), ("como ia", "como um ia", "como uma ia", "inteligência artificial"), ("modelo de linguagem",), ("não posso",), ("não posso",), ("claro,", "claro!"), ("```",), ("<|",), ("assistant", "system", "user"), ('"corpo_md"',),
)


def refusal_labels(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low

    def met(parts: tuple[str, ...]) -> Column:
        out = F.contains(low, F.lit(parts[0]))
        for part in parts[1:]:
            out = out | F.contains(low, F.lit(part))
        return out

    return F.array_compact(F.array(*(F.when(met(parts) & text.rlike(pattern), F.lit(label)) for parts, (pattern, label) in zip(FRAGMENTS, REFUSALS, strict=True))))


def refusal_rule() -> Column:
    return F.when(F.size("__refusals") > 0, F.array(F.array_join("__refusals", ", "))).otherwise(_empty())


def rite_rule() -> Column:
    """A vetoed term is an error unless the original has one of the English terms behind it."""
    text, original = F.col("__plain"), F.col("__original_low")
    errors = []
    for term, origins in VETOED:
        allowed = F.lit(False)
        for o in origins:
            allowed = allowed | F.contains(original, F.lit(o))
        errors.append(F.when(F.contains(text, fold(F.lit(term))) & ~allowed, F.lit(term)))
    return F.array(*errors)


def english_terms(text: Column, low: Column, terms: tuple[str, ...] = TRANSLATE) -> Column:
    """The terms that stand in the text."""
    return F.array_compact(F.array(*(F.when(holds_term(text, t, low), F.lit(t)) for t in terms)))


def glossary_rule() -> Column:
    return F.when(F.size("__terms") > 0, F.array(F.array_join(F.slice("__terms", 1, 8), ", "))).otherwise(_empty())


#: All nine rules in order, for rules.judge over facts() of rows that also have source, source_name, source_url and verdict.
NINE_RULES = (
    ("comprimento", length_rule), ("proporcao", ratio_rule), ("atribuicao", attribution_rule), ("numeros", number_rule), ("verificacao_factual", verdict_rule),
    ("idioma", language_rule), ("recusa_do_modelo", refusal_rule), ("rito_1962", rite_rule), ("glossario", glossary_rule),
)
