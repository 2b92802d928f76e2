"""Centroid clustering by annulus search, in exact integers.

A vector no farther than u from a centroid differs from it in norm by u at most. Centroids are sorted
by norm; each vector gets u from the centroids next to it in that order, finds the ones of norms within
u of its own by binary search, and is compared exactly with those alone. Bounds allow for the rounding
of the norms and keep centroids at the very edge, so that ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import LONGEST, cell_means, finite, steps

#: Far above the relative rounding error of norms (2^-51), far below what one comparison more would cost.
SLACK = 1e-12


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


class Annuli:
    """Centroids (rows of int64), sorted by norm for the search."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt(squares(centroids).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], centroids[self.order]

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's range [low, high) of centroids in order of norm: all that can be nearest."""
        norms = np.sqrt(squares(x).astype(np.float64))
        at = np.searchsorted(self.norms, norms)
        near = [squares(x - self.sorted[np.clip(at + k, 0, len(self.norms) - 1)]) for k in (-1, 0)]
        reach = np.sqrt(np.minimum(*near).astype(np.float64)) * (1 + SLACK) + SLACK * (norms + self.norms[-1])
        return np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; ties to the smaller number."""
        low, high = self.candidates(x)
        best, found = np.full(len(x), LONGEST, np.int64), np.full(len(x), len(self.order), np.int64)
        for k, number in enumerate(self.order):
            rows = np.flatnonzero((low <= k) & (k < high))
            far = squares(x[rows] - self.sorted[k])
            closer = (far < best[rows]) | ((far == best[rows]) & (number < found[rows]))
            best[rows[closer]], found[rows[closer]] = far[closer], number
        return found, best


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", salt: str = "1:") -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string) for each row whose vector has dim finite components.

    A component x is floor(scale * x). Centroids start as the k vectors with the smallest sha256 of salt and id and move
    ``rounds`` times to the floor of their vectors' mean; empty ones stay. Vectors that are null, of another length or
    with null or non-finite components take no part. A null id reads as an empty one; repeated ids and rows are vectors
    of their own (of equal ids the smaller vector starts first). Fewer than k vectors make as many centroids; none, an
    empty result. Integers beyond ``vectors.bound`` stand at it, and sums beyond a long at its largest value. Other
    columns are not read. The driver holds k * dim numbers; a partition sends as many to the mean.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).filter((F.size("vec") == dim) & finite(F.col("vec")))
    start = rows.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    centroids = next(x for _, x in steps(pa.record_batch([pa.array([r["vec"] for r in start], pa.list_(pa.float64()))], ["vec"]), 0, dim, scale)) if start else np.zeros((0, dim), np.int64)
    for _ in range(rounds if start else 0):
        search = Annuli(centroids)
        means = cell_means(rows.select("vec"), dim, scale, len(centroids), dim, lambda x, search=search: [(search.nearest(x)[0], x)])
        for number, mean in means.items():
            centroids[number] = mean
    search = Annuli(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in steps(batch, 1, dim, scale):
                number, far = search.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    told = written(rows.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), LONGEST)
    named = [(j, min(s, LONGEST), total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    small = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(small), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, salt: str = "1:") -> str:
    """DuckDB SQL for cluster over embeddings: every vector against every centroid."""
    away = "cast(list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    steps_sql = [f"""
rows as (select row_number() over () n, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) v from embeddings
         where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as (select row_number() over (order by sha256('{salt}' || coalesce(cast(vec_id as varchar), '')), v) - 1 j, v from rows qualify j < {k})"""]
    for t in range(rounds + 1):
        steps_sql.append(f"d{t} as (select r.n, c.j, {away} d from rows r, c{t} c)")
        steps_sql.append(f"a{t} as (select n, j, d from d{t} qualify row_number() over (partition by n order by d, j) = 1)")
        if t < rounds:
            steps_sql.append(f"u{t} as (select j, unnest(r.v) x, generate_subscripts(r.v, 1) pos from a{t} join rows r using (n))")
            steps_sql.append(f"s{t} as (select j, pos, sum(x) s, count(*) m from u{t} group by 1, 2)")
            steps_sql.append(f"m{t} as (select j, list(cast((s - ((s % m) + m) % m) // m as bigint) order by pos) v from s{t} group by 1)")
            steps_sql.append(f"c{t + 1} as (select j, coalesce(m.v, c.v) v from c{t} c left join m{t} m using (j))")
    return f"""
with {", ".join(steps_sql)}
select vec_id, cast(j as integer) as cluster, d as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} join rows using (n) join c{rounds} c using (j)
"""
