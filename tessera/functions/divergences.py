"""Which divergences that a fact check reports are noise: the quoted pair holds the same numbers, months and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import GRAMMATICAL, MONTH_WORDS, NAMES, NEGATION, ONE_WORD_TERMS, TITLE_WORDS
from .text import fold

#: Letters at the beginning by which two names are one.
PREFIX = 4
# A pair that says which side is the original's, and a quoted span.
STATED = r"(?i)[\"“]([^\"”“]{2,400})[\"”]\s*[—–-]\s*(?:no|o)?\s*original\s+(?:dizia|diz|era|traz|afirma)\s*:?\s*[\"“]([^\"”“]{2,400})[\"”]"
QUOTED = r"[\"“]([^\"”“]{2,400})[\"”]"


def normal(word: Column) -> Column:
    """Folded, without signs at its ends."""
    return F.regexp_replace(fold(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def quoted_pair(divergence: Column) -> Column:
    """struct(adapted, original): the pair that names the original, else the only two quoted spans; null for anything else."""
    stated = F.struct(F.regexp_extract(divergence, STATED, 1).alias("adapted"), F.regexp_extract(divergence, STATED, 2).alias("original"))
    spans = F.regexp_extract_all(divergence, F.lit(QUOTED), F.lit(1))
    two = F.struct(F.get(spans, F.lit(0)).alias("adapted"), F.get(spans, F.lit(1)).alias("original"))
    return F.when(divergence.rlike(STATED), stated).when(F.size(spans) == 2, two)


def hard_tokens(fragment: Column) -> Column:
    """struct(numbers, months, names): digits without separators, months by number, capitalised words and Roman numerals that are neither titles nor grammatical. Sets, as arrays in order of appearance."""
    plain = F.regexp_replace(fragment, r"(\d)[.,](?=\d{3}\b)", "$1")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.regexp_replace(n, r"^0+(?=\d)", "")))
    words = F.filter(F.transform(F.split(fragment, r"[\s,;:()\[\]{}\"“”'’]+"), lambda w: F.struct(w.alias("raw"), normal(w).alias("key"))), lambda w: w["key"] != "")
    number = F.create_map(*(F.lit(x) for k, names in enumerate(MONTH_WORDS) for name in names for x in (name, k + 1)))
    months = F.array_distinct(F.filter(F.transform(words, lambda w: number[w["key"]]), lambda m: m.isNotNull()))
    no_name = F.create_map(*(x for w in sorted({*TITLE_WORDS, *GRAMMATICAL}) for x in (F.lit(w), F.lit(True))))
    named = F.filter(
        words,
        lambda w: number[w["key"]].isNull() & no_name[w["key"]].isNull() & (w["raw"].rlike(r"^\p{Lu}") | F.regexp_replace(w["raw"], "[.,]", "").rlike("^[IVXLCDM]{1,7}$")) & (F.length(w["key"]) >= 2),
    )
    return F.struct(numbers.alias("numbers"), months.alias("months"), F.array_distinct(F.transform(named, lambda w: w["key"])).alias("names"))


def same_set(a: Column, b: Column) -> Column:
    """Two arrays without repeats hold the same."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def _pairs() -> dict[str, list[str]]:
    """Both directions of the names and one-word terms that stand for each other, folded as names are."""
    import unicodedata

    plain = lambda w: "".join(x for x in unicodedata.normalize("NFD", w) if not unicodedata.combining(x)).lower().strip(".")
    out: dict[str, list[str]] = {}
    for a, b in [*ONE_WORD_TERMS.items(), *NAMES.items()]:
        for x, y in ((plain(a), plain(b)), (plain(b), plain(a))):
            if x != y and y not in out.setdefault(x, []):
                out[x].append(y)
    return out


def cognates(a: Column, b: Column) -> Column:
    return (F.least(F.length(a), F.length(b)) >= PREFIX) & (F.left(a, F.lit(PREFIX)) == F.left(b, F.lit(PREFIX)))


def all_present(names: Column, others: Column) -> Column:
    """Every name has a counterpart: itself, one that stands for it, or a cognate."""
    stands_for = F.create_map(*(x for w, alts in _pairs().items() for x in (F.lit(w), F.array(*map(F.lit, alts)))))
    return F.forall(names, lambda n: F.array_contains(others, n) | F.coalesce(F.arrays_overlap(stands_for[n], others), F.lit(False)) | F.exists(others, lambda o: cognates(n, o)))


def negation_differs(pair: Column) -> Column:
    return pair["adapted"].rlike(NEGATION) != pair["original"].rlike(NEGATION)


def with_noise(rows: DataFrame, divergence: str) -> DataFrame:
    """rows with adapted and original (the pair's hard tokens) and noise: whether the divergence is noise; what can't be read as a pair isn't. Each text is read once."""
    made = rows.withColumn("__pair", quoted_pair(F.col(divergence)))
    made = made.withColumns({"adapted": hard_tokens(F.col("__pair.adapted")), "original": hard_tokens(F.col("__pair.original"))})
    a, o = F.col("adapted"), F.col("original")
    same = same_set(a["numbers"], o["numbers"]) & same_set(a["months"], o["months"]) & all_present(o["names"], a["names"]) & all_present(a["names"], o["names"])
    return made.withColumn("noise", F.coalesce(F.col("__pair").isNotNull() & ~negation_differs(F.col("__pair")) & same, F.lit(False))).drop("__pair")
