"""Idempotent merges by key. A copied key may hold a third of the rows, so firsts come from aggregates, not windows, and joins split such keys; null keys stay.

Joins are null-safe: rows with a null key are one key. Where several rows of a batch share key and
order, only the one with the smallest row hash counts as first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SLUG, with_suffix
from ..sources.shared import kept
from .skew import null_safe, split_join


def _place(order: str, columns: list[str]) -> Column:
    """What orders a key's rows: the order column, then a hash of the row."""
    return F.struct(F.col(order).alias("o"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(columns)]).alias("h"))


def classify_batch(target: DataFrame, batch: DataFrame, key: str, order: str, content: str | None = None) -> DataFrame:
    """batch with outcome: 'new' for a key's first row that target lacks, 'updated' where target's content differs (null is a content), else 'duplicate'.

    Later rows of a new key are duplicates. Null keys are one key. Rows alike in all columns that are first are all new.
    """
    keyed, place = batch.withColumn("__k", null_safe(key)), _place(order, batch.columns)
    held = target.groupBy(null_safe(key).alias("__k")).agg(F.max(F.col(content)).alias("__content") if content else F.lit(None).cast("string").alias("__content"), F.lit(True).alias("__known"))
    keys = keyed.groupBy("__k").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).join(held, "__k", "left")
    joined = split_join(keyed, keys, ["__k"], "__n", batch.count())
    known = F.col("__known").isNotNull()
    outcome = F.when(~known & (place == F.col("__first")), "new")
    if content:
        outcome = outcome.when(known & ~F.col(content).eqNullSafe(F.col("__content")), "updated")
    return joined.withColumn("outcome", outcome.otherwise("duplicate")).select(*batch.columns, "outcome")


def first_rows(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's first row, by ``order`` and then by the row's hash. Null keys are one key."""
    first = batch.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*batch.columns), _place(order, batch.columns)).alias("__row"))
    return first.select("__row.*")


def insert_new(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """target and the batch's new rows, each once; merging twice changes nothing."""
    fresh = classify_batch(target, batch, key, order).filter("outcome = 'new'").drop("outcome")
    return target.unionByName(fresh.select(*target.columns).distinct())


def refreshed(target: DataFrame, batch: DataFrame, key: str, order: str, content: str, columns: tuple[str, ...]) -> DataFrame:
    """target with ``columns`` and content taken from the batch's first row of a key whose content differs; other rows and columns stay. Keys are unique in target. A key that many rows of the batch share is reduced before it is moved."""
    first = batch.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(content, *columns), _place(order, batch.columns)).alias("__new"))
    joined = target.join(first, F.col(key).eqNullSafe(F.col("__key")), "left")
    changed = F.col("__new").isNotNull() & ~F.col(content).eqNullSafe(F.col(f"__new.{content}"))
    return joined.select(*(F.when(changed, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in (content, *columns) else F.col(c) for c in target.columns))


def point_update(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with the values of changes (unique keys); columns that changes lacks and null values in it leave the old ones."""
    renamed = changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    joined = target.join(renamed, F.col(key) == F.col("__key"), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in target.columns))


def adopt(target: DataFrame, batch: DataFrame, key: str = "key", slug: str = "slug", same: tuple[str, ...] = ("source", "title")) -> DataFrame:
    """batch with outcome, final_slug and asked_slug (see free_slugs), as an insert one by one in order of ``position`` would have it.

    A known key is 'duplicate', or 'updated' where its content differs. Of an unknown key the first row
    is 'adopted' where the target holds its slug with the same source and title (the story moved to a new
    address; the slug stays), else 'new' with the first slug that is free by then (see free_slugs; the suffix is the
    key's first six characters). Columns: key, slug, content, position (unique) and ``same``. Slugs and keys that many rows share are split.
    """
    rows = classify_batch(target, batch, key, "position", content="content")
    holder = target.filter(F.col(slug) != "").groupBy(F.col(slug).alias("__slug")).agg(F.min(F.struct(*same)).alias("__holder"))
    asked = rows.filter(F.col(slug) != "").groupBy(F.col(slug).alias("__slug")).agg(F.count(F.lit(1)).alias("__n"))
    known = holder.join(asked, "__slug")
    total = known.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    joined = split_join(rows.withColumn("__slug", F.col(slug)), known, ["__slug"], "__n", total, "left").drop("__slug")
    moved = F.col("__holder").isNotNull() & F.col("__holder").eqNullSafe(F.struct(*same))
    placed = kept(joined.withColumn("outcome", F.when((F.col("outcome") == "new") & moved, "adopted").otherwise(F.col("outcome"))).drop("__holder"), "outcomes")
    fresh = placed.filter("outcome = 'new'").withColumn("__suffix", F.substring(key, 1, 6))
    named = free_slugs(fresh, target.select(F.col(slug)), slug, "position", "__suffix").drop("__suffix")
    held = F.when(F.col("outcome") == "adopted", F.col(slug))
    rest = placed.filter("outcome <> 'new'").withColumns({"final_slug": held, "asked_slug": held})
    return named.unionByName(rest).select(*batch.columns, "outcome", "final_slug", "asked_slug")


def tallies(rows: DataFrame) -> DataFrame:
    """One row: seen, new, duplicate (updated and adopted ones among them), updated."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return rows.agg(F.count(F.lit(1)).alias("items_seen"), is_("new").alias("items_new"), is_("duplicate", "updated", "adopted").alias("items_duplicate"), is_("updated", "adopted").alias("items_updated"))


def coalescing_upsert(target: DataFrame, batch: DataFrame, key: str, overwrite: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Rows of both by key: overwrite columns are the batch's where it has the key, keep columns are the batch's unless null. Keys are unique in target; of a batch's rows of one key the one with the smallest row hash counts."""
    rows = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.xxhash64(*batch.columns)).alias("r")).select("r.*")
    t, b = target.alias("t"), rows.withColumn("__has", F.lit(True)).alias("b")
    has = F.col("b.__has").isNotNull()
    cols = [F.coalesce(f"b.{key}", f"t.{key}").alias(key)]
    cols += [F.when(has, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in overwrite]
    cols += [F.coalesce(f"b.{c}", f"t.{c}").alias(c) for c in keep]
    return t.join(b, F.col(f"t.{key}").eqNullSafe(F.col(f"b.{key}")), "full").select(*cols)


def free_slugs(batch: DataFrame, taken: DataFrame, slug: str, order: str, suffix: str, present: str | None = None) -> DataFrame:
    """batch with final_slug: of each row's wishes the first that is free when rows are taken one by one in ``order`` (then by a hash of the row; rows equal in all columns are one and get the same).

    Wishes: the slug, then the slug with the suffix (cut to the length that slugs may have; a null or empty slug is
    noticia-suffix and has no other), then the row's present slug, which is its own already. A slug is free when it is not
    in taken and no row before has it; present slugs stay taken for other rows, also when their owners leave them. A row
    without a free wish has null; asked_slug is the wish it asked for last, free or not. Every round each row asks for its first wish that hasn't been refused, and a slug stays with the
    earliest that asks for it; the loop ends when none is refused. That gives what one by one gives, as all slugs
    prefer the same rows. A slug that many rows ask for is split.
    """
    base = F.nullif(F.col(slug), F.lit(""))
    own = [F.col(present)] if present else []
    used = taken.select(F.col(slug).alias("__s"))
    used = used.unionByName(batch.select(F.col(present).alias("__s"))) if present else used
    used = kept(used.filter("__s is not null").distinct().withColumn("__used", F.lit(True)), "used")
    state = kept(batch.select(F.struct(*batch.columns).alias("__row"), _place(order, batch.columns).alias("__at"), F.array_compact(F.array(base, with_suffix(base, F.col(suffix), most=SLUG), *own)).alias("__wishes"), F.lit(0).alias("__k"), (F.col(present) if present else F.lit(None).cast("string")).alias("__own")), "wishes")
    total = state.count()
    while True:
        asked = state.withColumn("__s", F.get("__wishes", F.col("__k")))
        # Of those that ask, the table refuses all but a slug's owner, and the earliest of the others is chosen.
        keys = asked.filter("__s is not null").groupBy("__s").agg(F.min(F.struct(~F.col("__s").eqNullSafe(F.col("__own")), "__at")).alias("__first"), F.count(F.lit(1)).alias("__n")).join(used, "__s", "left")
        joined = split_join(asked.filter("__s is not null"), keys, ["__s"], "__n", total)
        mine = F.struct(~F.col("__s").eqNullSafe(F.col("__own")), "__at")
        won = (mine == F.col("__first")) & (F.col("__used").isNull() | (F.col("__s") == F.col("__own")))
        told = joined.withColumn("__k", F.when(won, F.col("__k")).otherwise(F.col("__k") + 1)).withColumn("__lost", ~won)
        done = asked.filter("__s is null").withColumn("__lost", F.lit(False))
        state = kept(told.select(*asked.columns, "__lost").unionByName(done.select(*asked.columns, "__lost")), "wishes")
        if not state.filter("__lost").limit(1).count():
            break
        state = state.drop("__s", "__lost")
    return state.select(*(F.col(f"__row.{c}").alias(c) for c in batch.columns), F.col("__s").alias("final_slug"), F.get("__wishes", F.least("__k", F.size("__wishes") - 1)).alias("asked_slug"))
