"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector's direction is rotated and kept as sign bits with two scalars: its length and the inner
product of the code with the rotated direction. A query is rotated and cut into bit planes; AND
and popcount over packed words give an unbiased estimate of every inner product, with an error
bound that depends on the stored scalar. Vectors whose upper bound reaches the k-th best are
reranked with exact inner products. Queries and candidates meet in blocks; a task takes a block
of queries through its share of the candidates' blocks and gives k results a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDIDATE_BLOCK, QUERY_BLOCK, STEP = 2048, 1024, 64
QUERY_BITS = 6
#: Standard deviations that the bound allows for.
EPSILON = 2.4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits as words, lengths, inner products of code and rotated direction)."""
    dim, largest = vectors.shape[1], np.abs(vectors).max(axis=1)
    scaled = vectors / largest[:, None]  # squares of very large and very small components stay in range
    norms = np.linalg.norm(scaled, axis=1)
    turned, lengths = (scaled / norms[:, None]) @ turn.T, largest * norms
    bits = np.zeros((len(vectors), -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = turned > 0
    return np.packbits(bits, axis=1).view(np.uint64), lengths, np.abs(turned).sum(axis=1) / math.sqrt(dim)


def estimate(codes: np.ndarray, lengths: np.ndarray, fits: np.ndarray, queries: np.ndarray, turn: np.ndarray, bits: int = QUERY_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and their error bounds."""
    dim = queries.shape[1]
    turned = queries @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << bits) - 1), 1e-300)
    whole = np.rint((turned - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    met = np.zeros((len(queries), len(codes)), np.int64)
    padded = np.zeros((len(queries), codes.shape[1] * 64), np.uint8)
    for b in range(bits):
        padded[:, :dim] = (whole >> b) & 1
        plane = np.packbits(padded, axis=1).view(np.uint64)
        for w in range(codes.shape[1]):
            met += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int64) << b
    # sum of sign * q over dimensions, with q = low + step * whole and sign = 2 * bit - 1
    signed = 2 * (low * ones[None, :] + step * met) - (low * dim + step * whole.sum(axis=1, dtype=np.int64)[:, None])
    guess = lengths[None, :] * signed / (math.sqrt(dim) * fits[None, :])
    spread = np.sqrt(np.maximum(1 - fits**2, 0)) / fits / math.sqrt(max(dim - 1, 1))
    norms = np.linalg.norm(queries, axis=1)[:, None]
    bound = EPSILON * lengths[None, :] * (norms * spread[None, :] + step / math.sqrt(12) / fits[None, :])
    return guess, bound


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; one that is no number in double precision is the smallest."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (vectors * query).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, exact inner products) of each query's k best in the block, by code, bound and rerank; a candidate counts as often as ``copies`` says."""
    codes, lengths, fits = encode(vectors, turn)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), STEP):
        q = queries[at : at + STEP]
        with np.errstate(over="ignore", invalid="ignore"):
            guess, bound = estimate(codes, lengths, fits, q, turn)
        bound[~np.isfinite(guess) | ~np.isfinite(bound)] = np.inf  # beyond double range the exact product decides
        guess[~np.isfinite(guess)] = np.finfo(float).max
        guess[query_ids[at : at + STEP, None] == ids[None, :]] = -np.inf
        for row in range(len(q)):
            take = min(k, len(ids))
            lead = np.argpartition(-guess[row], take - 1)[:take]
            lead = lead[np.isfinite(guess[row, lead])]
            if not len(lead):
                continue
            least = products(vectors[lead], q[row]).min() if len(lead) == k else -np.inf
            held = np.isfinite(guess[row])
            picked = np.flatnonzero(held & (np.where(held, guess[row], 0) + bound[row] >= least))
            picked = np.union1d(picked, lead)
            exact = products(vectors[picked], q[row])
            picked, exact = np.repeat(picked, copies[picked]), np.repeat(exact, copies[picked])
            best = np.lexsort((ids[picked], -exact))[:k]
            out.append((np.full(len(best), query_ids[at + row]), ids[picked[best]], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k largest scores, smaller ids first on a tie."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    kept = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[kept], ids[kept], scores[kept]


def usable(vec: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not all zero."""
    value = lambda x: x.cast("double")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: value(x) != 0), F.lit(False))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row a block of (dim, block): its ids, vectors and copies as packed arrays. A block has a bounded number of rows."""

    def pack(group: pa.Table) -> pa.Table:
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("vec").chunks]).astype(np.float64)
        packed = (group.column("id").to_numpy().astype(np.int64), flat, group.column("copies").to_numpy().astype(np.int64))
        return pa.table({"dim": group.column("dim").combine_chunks()[:1], "block": group.column("block").combine_chunks()[:1]} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "vecs", "copies"), packed, strict=True)})

    return rows.select("dim", "block", "id", "vec", "copies").groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, vecs binary, copies binary")


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): each query's k nearest by largest inner product.

    Scores are exact, in double precision; ties go to the smaller id. A row whose id is the query's
    takes no part, nor do null ids and vectors that are null, empty, zero or hold null or non-finite
    components; such queries return no rows. Vectors are compared with those of their own length.
    Repeated ids count as separate candidates, equal rows too, and as one query each (the smallest vector's).
    Fewer than k candidates are all returned. Other columns are not read; without usable rows the result is empty.
    """
    spark = candidates.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))
    # Equal rows are one with a number, of which k matter at most, so that a block's size is bounded.
    rows = pick(candidates).groupBy("id", "vec", "dim").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("long").alias("copies"))
    asked = pick(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec")).withColumn("copies", F.lit(1).cast("long"))
    # A row a vector length: how many blocks its candidates and queries make, and in how many shares candidates are dealt.
    tasks, of = F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))), lambda c, n: F.ceil(F.col(c) / n).cast("int")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("dim").agg(F.count(F.lit(1)).alias("m")), "dim")
    sizes = sizes.select("dim", of("n", candidate_block).alias("n_rows"), of("m", query_block).alias("n_asked"))
    sizes = sizes.withColumn("shares", F.greatest(F.least(F.col("n_rows"), F.floor(tasks / F.col("n_asked")).cast("int")), F.lit(1)))
    dealt = lambda df, count: _blocks(df.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.col(count)).cast("int"))).join(sizes, "dim")
    # Each task takes one block of queries through its share of the candidates, and keeps k a query.
    left = dealt(rows, "n_rows").select("dim", F.pmod("block", "shares").alias("share"), "ids", "vecs", "copies", F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)).alias("qb"))
    right = dealt(asked, "n_asked").select("dim", F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, best = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                dim, at = row["dim"], (row["dim"], row["qb"])
                turn = turns.setdefault(dim, None)
                if turn is None:
                    turn = turns[dim] = rotation(dim, seed)
                ids, q_ids, copies = (np.frombuffer(row[c], np.int64) for c in ("ids", "q_ids", "copies"))
                vecs, q_vecs = np.frombuffer(row["vecs"]).reshape(-1, dim), np.frombuffer(row["q_vecs"]).reshape(-1, dim)
                found = search_block(q_ids, q_vecs, ids, vecs, copies, turn, k)
                best[at] = best_of(*(np.concatenate(x) for x in zip(best[at], found, strict=True)), k) if at in best else best_of(*found, k)
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    pairs = left.join(right.hint("shuffle_hash"), ["dim", "share", "qb"]).select("dim", "qb", "ids", "vecs", "copies", "q_ids", "q_vecs")
    local = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
