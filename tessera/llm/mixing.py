"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is the share that it should have over the share that it has. Each document draws
its number of copies by inverting a Poisson distribution of that mean at a uniform number hashed
from seed, the row's digest (all of its columns) and its number among equal rows, so that every row draws
for itself and a rerun after a loss draws the same. A mean above PART_RATE is the sum of equal
parts with a number each, so that no distribution's table grows with the mean. Copies are exploded and shuffled by a
hash over all partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import split_join
from .common import written

#: The sources' distributions are broadcast up to this many bytes, counted before; above it, the join is salted.
BROADCAST_BYTES, SALTS = 16 << 20, 64
#: Largest rate of one inversion: a larger one is split in equal parts, whose draws add up. Copies that one array holds.
PART_RATE, ARRAY = 64.0, 4096
DEFAULT_SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the parts' md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(df: DataFrame, weights: dict[str, float] | None, source_col: str = "source", default_weight: float = 1.0, total: float = 1.0) -> DataFrame:
    """(source, n, rate): rate = total * N * weight / (sum of weights * n), so that copies expect total * N rows in all.

    Sources that weights leaves out have default_weight; a null source is a source of its own, ''.
    """
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = df.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    given = F.lit(float(default_weight))
    for key, weight in (weights or {}).items():
        given = F.when(F.col("source") == key, F.lit(float(weight))).otherwise(given)
    sums = counts.withColumn("w", given).agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()
    all_n, all_w = float(sums["all_n"] or 0), float(sums["all_w"] or 0)
    return counts.withColumn("w", given).select("source", "n", (F.lit(total * all_n) * F.col("w") / (F.lit(all_w or 1.0) * F.col("n"))).alias("rate"))


def poisson_tables(rate: DataFrame) -> DataFrame:
    """(source, n, rate, parts, cdf array): rate is one part's; P(copies <= k) for k from 0 until the tail is under double precision."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("long")
    split = rate.withColumn("parts", parts).withColumn("rate", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    steps = split.select("source", "n", "rate", "parts", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    run = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    logs = F.sum(F.when(F.col("k") > 0, F.log(F.col("k"))).otherwise(0.0)).over(run)
    term = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial"))).otherwise((F.col("k") == 0).cast("double"))
    cdf = F.sum("term").over(run)
    steps = steps.withColumn("log_factorial", logs).withColumn("term", term).withColumn("cdf", cdf)
    return steps.groupBy("source", "n", "rate", "parts").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf"))


def row_digest(columns: list[str]) -> Column:
    """A digest of the row's values, a null one apart from an empty one."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns)))


def numbered(rows: DataFrame, digest: str, number: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with each one's number among those of its digest, from 1. Only rows that are repeated are moved, and those of one digest are numbered by the partition they came from."""
    repeated = written(rows.groupBy(digest).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "repeats")
    size = repeated.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()
    if not size["k"]:
        return rows.withColumn(number, F.lit(1).cast("long"))
    marks, placed = repeated.withColumn("__again", F.lit(True)), rows.withColumn("__at", F.monotonically_increasing_id())
    marked = placed.join(F.broadcast(marks.drop("__n")), digest, "left") if 64 * size["k"] <= broadcast_bytes else split_join(placed, marks, [digest], "__n", size["n"], "left")
    again = written(marked.filter("__again").drop("__again").withColumn("__part", F.spark_partition_id()), "repeated")
    before = Window.partitionBy(digest).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = again.groupBy(digest, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(digest, "__part").orderBy("__at"))
    told = again.withColumn("__place", place).join(offsets.select(digest, "__part", "__before"), [digest, "__part"]).withColumn(number, F.col("__before") + F.col("__place"))
    alone = marked.filter("__again is null").withColumn(number, F.lit(1).cast("long"))
    return alone.select(*rows.columns, number).unionByName(told.select(*rows.columns, number))


def poisson_replicate(df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", seed: str = DEFAULT_SEED, default_weight: float = 1.0, total: float = 1.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df's rows, each as often as it draws, with copy long (from 1), n_copies long and order_key string, shuffled globally.

    Columns of df that have those names are replaced. Every row draws by itself, whatever it holds: null and repeated
    ids, nulls elsewhere, empty and long texts; rows that are equal in all columns have numbers from 1, which are part
    of the draw. A null source is a source of its own, ''. Weight 0 drops a source; without weights every source has
    default_weight. An empty table gives an empty result. Within a partition rows stand in order of order_key, a hash of
    seed, row, its number and copy number, which no two rows share. A source's part of the tables is at most 210 numbers,
    whatever its rate. df is read twice and must read alike each time.
    """
    kept = [c for c in df.columns if c not in ("copy", "n_copies", "order_key")]
    base = df.select(*(F.col(f"`{c}`") for c in kept))
    tables = poisson_tables(rates(base.select(source_col), weights, source_col, default_weight, total)).select(F.col("source").alias("__mix_source"), F.col("cdf").alias("__mix_cdf"), F.col("parts").alias("__mix_parts"))
    keyed = numbered(base.withColumn("__mix_row", row_digest(kept)), "__mix_row", "__mix_no", broadcast_bytes).withColumn("__mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    ident = F.concat_ws("|", F.lit(seed), F.col("__mix_row"), F.col("__mix_no").cast("string"))
    size = tables.agg(F.sum(F.octet_length("__mix_source") + 8 * F.size("__mix_cdf") + 64).alias("bytes")).first()["bytes"] or 0
    if size <= broadcast_bytes:
        joined = keyed.join(F.broadcast(tables), "__mix_source")
    else:
        salted = tables.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("__mix_salt", F.pmod(F.xxhash64("__mix_row", "__mix_no"), F.lit(SALTS)).cast("int")).join(salted, ["__mix_source", "__mix_salt"])
    drawn_at = lambda u: F.size(F.filter("__mix_cdf", lambda c: c <= u)).cast("long")
    drawn = joined.withColumn("__mix_u", uniform(ident))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("__mix_parts") - 1), F.lit(0).cast("long"), lambda acc, j: acc + drawn_at(uniform(ident, j.cast("string"))))
    drawn = drawn.withColumn("n_copies", drawn_at(F.col("__mix_u")) + F.when(F.col("__mix_parts") > 1, more).otherwise(F.lit(0).cast("long")))
    copies = drawn.filter("n_copies > 0").withColumn("__mix_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"), F.lit(ARRAY).cast("long"))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("__mix_at"), F.least(F.col("__mix_at") + (ARRAY - 1), F.col("n_copies")))))
    out = copies.select(*(F.col(f"`{c}`") for c in kept), "copy", "n_copies", F.md5(F.concat_ws("|", ident, F.lit("copy"), F.col("copy").cast("string"))).alias("order_key"))
    return out.repartition("order_key").sortWithinPartitions("order_key")


def oracle(weights: dict[str, float], seed: str = DEFAULT_SEED, default_weight: float = 1.0, docs: str = "documents", columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> str:
    """DuckDB SQL for poisson_replicate over documents, whose columns are ``columns``."""
    given = "".join(f" when source = '{k}' then {float(v)!r}" for k, v in weights.items())
    weight = f"case{given} else {float(default_weight)!r} end" if given else repr(float(default_weight))
    unit = "cast(('0x' || substr(md5({}), 1, 13)) as bigint) / 4503599627370496.0"
    first, part = (unit.format(f"ident{more}") for more in ("", " || '|' || cast(j as varchar)"))
    digest = ", ".join(f"coalesce(md5(cast({c} as varchar)), 'n')" for c in columns)
    return f"""
with counts as (select coalesce(source, '') source, count(*) n from {docs} group by 1),
weighted as (select source, n, cast({weight} as double) w from counts),
whole as (select source, (select sum(n) from weighted) * w / ((select sum(w) from weighted) * n) rate from weighted),
rates as (select source, greatest(ceil(rate / {PART_RATE!r}), 1) parts, rate / greatest(ceil(rate / {PART_RATE!r}), 1) rate from whole),
steps as (select source, rate, parts, k, sum(case when k > 0 then ln(k) else 0.0 end) over (partition by source order by k) lf
          from (select *, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint) + 1)) k from rates)),
cdfs as (select source, parts, k, sum(case when rate > 0 then exp(k * ln(case when rate > 0 then rate else 1 end) - rate - lf) when k = 0 then 1.0 else 0.0 end)
         over (partition by source order by k) cdf from steps),
dists as (select source, cast(max(parts) as bigint) parts, list(cdf order by k) cdf from cdfs group by source),
keyed as (select *, md5(concat_ws('|', {digest})) digest from {docs}),
named as (select *, '{seed}|' || digest || '|' || cast(row_number() over (partition by digest) as varchar) ident from keyed),
drawn as (select d.*, cast(len(list_filter(t.cdf, lambda c: c <= {first})) + coalesce(list_sum(list_transform(range(1, t.parts), lambda j: len(list_filter(t.cdf, lambda c: c <= {part})))), 0) as bigint) n_copies
          from named d join dists t on coalesce(d.source, '') = t.source)
select {", ".join(columns)}, cast(copy as bigint) as copy, n_copies, md5(ident || '|copy|' || cast(copy as varchar)) as order_key
from (select *, unnest(range(1, n_copies + 1)) as copy from drawn where n_copies > 0)
"""
