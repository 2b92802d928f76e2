"""Guard-rails: every rule runs, its errors are an array, and an article passes without errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..dims import BODY, DEK, MAX_ERRORS, MIN_SOURCE, PARAGRAPHS, RATIO, TAGS, TITLE
from ..functions.text import paragraphs, stripped

# Characters of a recorded error, and what a rule that threw says.
MAX_CHARS, THREW = 500, "a própria checagem falhou ({}) — reprovado por precaução."


def _outside(value: Column, bounds: tuple, name: str) -> Column:
    return F.when((value < bounds[0]) | (value > bounds[1]), F.lit(name))


def _clean(name: str) -> Column:
    return stripped(F.coalesce(F.col(name), F.lit("")))


def length_rule() -> Column:
    """Columns body, title, dek, tags (null: none), trimmed; an empty body is the one error."""
    body, tags = F.col("__body"), F.coalesce(F.size("tags"), F.lit(0))
    rest = F.array(
        _outside(F.length(body), BODY, "body"), _outside(paragraphs(body), PARAGRAPHS, "paragraphs"), _outside(F.length(_clean("title")), TITLE, "title"), _outside(F.length(_clean("dek")), DEK, "dek"),
        _outside(F.greatest(tags, F.lit(0)), TAGS, "tags"),
    )
    return F.when(body == "", F.array(F.lit("empty"))).otherwise(rest)


def ratio_rule() -> Column:
    """The trimmed body's share of the source's length or, if smaller, of the original's where there is one."""
    length = F.coalesce(F.col("source_length"), F.lit(0)).cast("double")
    held = F.col("__original_size").cast("double")
    base = F.when(held > 0, F.least(length, held)).otherwise(length)
    ratio = F.length("__body") / F.nullif(base, F.lit(0.0))
    return F.array(F.when(length <= 0, "unknown source length").when(ratio > RATIO[1], "too long").when(ratio < RATIO[0], "too short"))


def too_long_alone(failed: Column) -> Column:
    """Whether writing less is all that is asked for: rules failed, and none but length and ratio. Such an answer is asked for once more."""
    return (F.size(failed) > 0) & F.forall(failed, lambda r: r.isin("comprimento", "proporcao"))


def prepared(pairs: DataFrame) -> DataFrame:
    """pairs with __whole (title, dek and body), __low, __original_low, __body (trimmed) and __original_size (the trimmed original's), which many rules read and which are made once a row."""
    made = pairs.withColumn("__whole", F.concat_ws("\n\n", "title", "dek", "body"))
    return made.withColumns({"__low": F.lower("__whole"), "__original_low": F.lower(F.coalesce("original", F.lit(""))), "__body": _clean("body"), "__original_size": F.length(_clean("original"))})


def _labelled(name: str) -> Callable[[Column], Column]:
    return lambda e: F.concat(F.lit(f"{name}: "), e)


@dataclass(frozen=True)
class RowRule:
    """A rule in Python: check gets the named columns of a batch as lists and gives a list of errors for each row."""

    name: str
    columns: tuple[str, ...]
    check: Callable[..., list[list[str]]]


def with_row_rules(rows: DataFrame, rules: tuple[RowRule, ...]) -> DataFrame:
    """rows with e_<name> array<string> of each rule. Where a rule throws on a batch, its rows are tried one by one, and a row on which it throws has that as its error; the others, and all other rules, go on."""
    if not rules:
        return rows
    names = rows.columns

    def one(rule: RowRule, cols: list[list], k: int) -> list[str]:
        try:
            return rule.check(*([c[k]] for c in cols))[0]
        except Exception as e:  # noqa: BLE001 - a rule that fails must not pass its row
            return [THREW.format(e)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rule in rules:
                cols = [batch.column(names.index(c)).to_pylist() for c in rule.columns]
                try:
                    found = rule.check(*cols)
                    if len(found) != batch.num_rows:
                        raise ValueError(f"{len(found)} answers for {batch.num_rows} rows")
                except Exception:  # noqa: BLE001 - told row by row
                    found = [one(rule, cols, k) for k in range(batch.num_rows)]
                made.append(pa.array(found, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *(f"e_{r.name}" for r in rules)])

    fields = [StructField(f"e_{r.name}", ArrayType(StringType())) for r in rules]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *fields]))


def judge(pairs: DataFrame, rules: tuple, row_rules: tuple[RowRule, ...] = ()) -> DataFrame:
    """pairs with the columns that the rules read (pairs of name and function; add one to plug in another), failed_rules, errors (20 at most of 500 characters at most, then how many more) and passed.

    row_rules run after the others, see with_row_rules.
    """
    made = (pairs if "__whole" in pairs.columns else prepared(pairs)).select("*", *(F.array_compact(rule()).alias(f"e_{name}") for name, rule in rules))
    made = with_row_rules(made, row_rules)
    names = [name for name, _ in rules] + [r.name for r in row_rules]
    every = F.concat(*(F.transform(f"e_{name}", _labelled(name)) for name in names))
    failed = F.array_compact(F.array(*(F.when(F.size(f"e_{name}") > 0, F.lit(name)) for name in names)))
    made = made.withColumn("failed_rules", failed).withColumn("every", every)
    more = F.size("every") - MAX_ERRORS
    short = F.transform(F.slice("every", 1, MAX_ERRORS), lambda e: F.when(F.length(e) > MAX_CHARS, F.concat(F.left(e, F.lit(MAX_CHARS)), F.lit("…"))).otherwise(e))
    capped = F.when(more > 0, F.array_append(short, F.concat(F.lit("(+"), more.cast("string"), F.lit(" erro(s) omitido(s))")))).otherwise(short)
    return made.withColumn("errors", capped).withColumn("passed", F.size("every") == 0).drop("every", *(c for c in made.columns if c.startswith("__")), *(f"e_{name}" for name in names))


def preflight(articles: DataFrame, least: int = MIN_SOURCE) -> DataFrame:
    return articles.withColumn("ready", (F.length(F.coalesce("source_excerpt", F.lit(""))) >= least) & (F.coalesce("source_length", F.lit(0)) > 0))
