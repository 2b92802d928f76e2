"""Vector code compression: product codes, found by a screened matrix product in exact integers.

A part's squared distance to an entry is its own square (equal for all entries) plus the entry's square
less twice the inner product. Inner products come from one float32 matrix product; their rounding error
is at most gamma(n) times the product of the norms, in whatever order they were added. Every entry whose
interval reaches down to the smallest upper end is computed anew in int64, and of equal distances the
lower index stays, so that codes are exact whatever the machine's arithmetic does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import null_safe, split_join
from .common import written
from .vectors import LONGEST, cell_means, finite, integers, steps

#: Unit roundoffs of single and double precision.
U32, U64 = 2.0**-24, 2.0**-53


def screened(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) booleans: the entries that can be nearest, by float32 products and their error intervals."""
    terms = x.shape[1] + 3  # both factors' conversion and every addition and multiplication of a sum
    gamma = terms * U32 / (1 - terms * U32)
    square = np.einsum("ij,ij->i", entries, entries).astype(np.float64)
    reach = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))[:, None] * np.sqrt(square)[None, :] * (1 + 8 * U64)
    guess = square[None, :] - 2.0 * (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    error = 2 * gamma * reach + 8 * U64 * (square[None, :] + 2 * reach)
    return guess - error <= (guess + error).min(axis=1, keepdims=True)


def nearest_entry(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row; ties to the lower index."""
    rows, cols = np.nonzero(screened(x, entries))
    gap = x[rows] - entries[cols]
    far = np.einsum("ij,ij->i", gap, gap)
    first = np.searchsorted(rows, np.arange(len(x)))
    best = np.minimum.reduceat(far, first) if len(x) else far
    hits = np.flatnonzero(far == best[rows])
    return cols[hits[np.searchsorted(rows[hits], np.arange(len(x)))]], best


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code string, error long, label_error long, codebooks_sha256 string) for each row with a finite vector.

    A component x is floor(scale * x); a vector is cut into ``parts`` equal parts. Codebooks start as the parts of the
    smallest ids (nulls last; of equal ids the smaller vector first) and move ``rounds`` times to the floor of their
    parts' mean; unused entries stay. Null vectors and those with null or non-finite components are dropped. Vectors of
    one length are coded: the most frequent that ``parts`` divides (of equally frequent ones the shorter); others
    stay with null code and error. Repeated rows are rows of their own. label_error adds up the errors of a label, of
    null labels together. Integers beyond ``vectors.bound`` stand at it, sums beyond a long at its largest value. Other
    columns are not read; without usable rows the result is empty. At most 256 entries, two hexadecimal digits each.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    id_type, label_type = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).filter(finite(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().filter((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    most = sizes.orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else parts
    width, fits = dim // parts, F.size("vec") == dim
    start = rows.filter(fits).orderBy(F.asc_nulls_last("id"), "vec").select("vec").limit(entries).collect()
    first = integers(np.array([r["vec"] for r in start], np.float64), dim, scale)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2))

    def placed(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for p in range(parts):
            part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
            yield *nearest_entry(part, books[p]), part

    for _ in range(rounds if len(first) else 0):
        place = lambda x, now=books: ((p * len(first) + at, part) for p, (at, _, part) in enumerate(placed(x, now)))
        books = books.copy()
        for cell, mean in cell_means(rows.filter(fits).select("vec"), dim, scale, parts * len(first), width, place).items():
            books[divmod(cell, len(first))] = mean

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in steps(batch, 2, dim, scale):
                found = list(placed(x, books))
                text = np.stack([at for at, _, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(sum(far for _, far, _ in found))], ["id", "label", "code", "error"])

    coded = rows.filter(fits).mapInArrow(encode, f"id {id_type}, label {label_type}, code string, error long")
    others = rows.filter(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    told = written(coded.unionByName(others).withColumn("__label", null_safe("label")), "codes")
    sums = told.groupBy("__label").agg(F.least(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)), F.lit(LONGEST)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = split_join(told, sums, ["__label"], "n", told.count())
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL for compress over embeddings of one length: every part against every entry of its codebook."""
    away = "cast(list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    steps_sql = [f"""
kept as (select row_number() over (order by vec_id nulls last, embedding) n, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) w from embeddings
         where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
rows as (select n, p, list_slice(w, p * len(w) // {parts} + 1, (p + 1) * len(w) // {parts}) v from kept, range({parts}) t(p)),
c0 as (select p, n - 1 e, v from rows where n <= {entries})"""]
    for t in range(rounds + 1):
        steps_sql.append(f"d{t} as (select r.n, r.p, c.e, {away} d from rows r join c{t} c using (p))")
        steps_sql.append(f"a{t} as (select n, p, e, d from d{t} qualify row_number() over (partition by n, p order by d, e) = 1)")
        if t < rounds:
            steps_sql.append(f"u{t} as (select p, e, unnest(r.v) x, generate_subscripts(r.v, 1) pos from a{t} join rows r using (n, p))")
            steps_sql.append(f"s{t} as (select p, e, pos, sum(x) s, count(*) m from u{t} group by 1, 2, 3)")
            steps_sql.append(f"m{t} as (select p, e, list(cast((s - ((s % m) + m) % m) // m as bigint) order by pos) v from s{t} group by 1, 2)")
            steps_sql.append(f"c{t + 1} as (select p, e, coalesce(m.v, c.v) v from c{t} c left join m{t} m using (p, e))")
    return f"""
with {", ".join(steps_sql)},
whole as (select n, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from a{rounds} group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from c{rounds}) as codebooks_sha256
from whole join kept using (n)
"""
