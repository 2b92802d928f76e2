"""Joins in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with this share of all rows (1 in HOT_SHARE) and at least HOT_LEAST of them; it is dealt to HOT_SALTS tasks.
HOT_SHARE, HOT_LEAST, HOT_SALTS = 1_000, 256, 64
#: Pairs of one key that a task makes.
HOT_PAIRS = 1 << 20


def null_safe(key: str) -> Column:
    """The key as text in which null is a value too."""
    return F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(key).cast("string")))


def split_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small (one row a key; ``weight``: about how many rows of big have the key), no key in one task.

    Keys with 1 in HOT_SHARE of ``total`` rows or more are at most HOT_SHARE in number, so that they can be broadcast: their rows of big
    are salted and their row of small is repeated once a salt. Keys that are null join nothing.
    """
    least = max(total // HOT_SHARE, HOT_LEAST)
    hot = small.filter(F.col(weight) >= least).select(*keys, F.lit(HOT_SALTS).alias("__salts"))
    rows = small.withColumn("__salt", F.explode(F.when(F.col(weight) >= least, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    salted = big.join(F.broadcast(hot), keys, "left")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in keys]), F.lit(HOT_SALTS)).cast("int")
    salted = salted.withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(salt)).drop("__salts")
    return salted.join(rows, [*keys, "__salt"], how).drop("__salt")


def split_pairs(left: DataFrame, right: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """All pairs of rows of left and right with the same key; a key of more than ``most`` (HOT_PAIRS) pairs is dealt to as many tasks as that takes.

    The rows of left are salted, those of right repeated once a salt. Both are read twice; other columns have names of their own. Null keys pair with nothing.
    """
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("__l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("__r")), key)
    sizes = sizes.withColumn("__deal", F.ceil(F.col("__l").cast("double") * F.col("__r") / (most or HOT_PAIRS)).cast("int"))
    total = sizes.agg(F.coalesce(F.sum("__l"), F.lit(0)).alias("l"), F.coalesce(F.sum("__r"), F.lit(0)).alias("r")).first()
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c != key]), F.col("__deal")).cast("int")
    dealt = split_join(left, sizes.select(key, "__deal", "__l"), [key], "__l", total["l"]).withColumn("__dealt", salt).drop("__deal")
    again = split_join(right, sizes.select(key, "__deal", "__r"), [key], "__r", total["r"]).withColumn("__dealt", F.explode(F.sequence(F.lit(0), F.col("__deal") - 1))).drop("__deal")
    return dealt.join(again, [key, "__dealt"]).drop("__dealt")
