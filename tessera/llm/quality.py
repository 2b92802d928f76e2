"""Quality classifier: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader.

A word is a run of letters and digits (bytes from 128 count as letters) or a run of other signs, cut at blanks.
It is read twice, as itself (A-Z lower-cased) and by its form (kind of sign, case, length); of both, single
words and pairs of neighbours are hashed to ``1 << BITS`` features. A pair of equal words is one feature
whatever is repeated. A document's features weigh
log(1 + count), scaled to length one. Learning goes through a bounded labelled sample one document after
another, each feature at its own pace, with an L1 threshold that keeps most weights at zero; scoring is a
sparse dot product in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import shares
from .words import pack, split_block, unpack

#: Feature bits. Bounds of the sample: documents a label, characters taken of each, features in all.
BITS, FIT_DOCS, FIT_CHARS, FIT_FEATURES = 18, 3_000, 20_000, 12_000_000
#: Learning: pace, smoothing of the pace, L1 and L2 weights, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.05, 0.1, 5
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32, 0]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_REPEAT, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def signed_words(data: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of one kind of byte other than blanks, and their number in each document; starts: where documents begin, and len(data)."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[starts] = True
    at = np.flatnonzero(edge)
    opens = at[:-1][kind[at[:-1]] != 0] if len(at) > 1 else at[:0]
    closes = at[1:][kind[at[:-1]] != 0] if len(at) > 1 else at[:0]
    marks = np.empty(2 * len(opens) + 1, np.int64)
    marks[:-1:2], marks[1::2], marks[-1] = opens, closes, len(data)
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(opens), [None, pa.py_buffer(marks), pa.py_buffer(data)])
    return pieces.take(pa.array(np.arange(0, 2 * len(opens), 2))), np.diff(np.searchsorted(opens, starts))


def form(word: bytes) -> bytes:
    """Signs: the first four. Others: upper case, capital, with digits or small letters, and a class of length."""
    if _KIND[word[0]] == 2:
        return word[:4]
    case = b"U" if len(word) > 1 and word.isalpha() and word.isupper() else b"C" if 65 <= word[0] <= 90 else b"d" if any(48 <= c <= 57 for c in word) else b"l"
    return b"w" + case + (b"1" if len(word) == 1 else b"2" if len(word) < 4 else b"3" if len(word) < 12 else b"4")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PAIR
    return h ^ (h >> np.uint64(29))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's features begin, and their end; feature; value), by feature within a text."""
    words, codes, counts = split_block(texts, signed_words)
    known = words.to_pylist()
    views = [np.array([xxhash.xxh3_64_intdigest(f(w), seed) for w in known], np.uint64)[codes] for seed, f in ((1, bytes.lower), (2, form))] if known else [np.zeros(0, np.uint64)] * 2
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = doc[1:] == doc[:-1]
    owners, keys = [doc, doc], views.copy()
    for h, repeats in zip(views, (views[0][1:] == views[0][:-1], False), strict=True):
        owners.append(doc[1:][inside])
        keys.append(np.where(repeats, _REPEAT, mixed(h[:-1] + np.uint64(3)) + h[1:])[inside])
    column = (mixed(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int64)
    cells, n = np.unique((np.concatenate(owners) << BITS) | column, return_counts=True)
    owner, value = cells >> BITS, np.log1p(n)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    size = np.sqrt(np.bincount(owner, value * value, minlength=len(texts)))
    return first, cells & ((1 << BITS) - 1), value / size[owner]


class Leader:
    """Weights that follow the regularised leader; the last one is the constant's."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        now = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(now) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = now


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, passes: int = PASSES) -> np.ndarray:
    """Weights learnt from at most fit_docs documents of label 1 and as many of label 0, chosen by a hash of the id.

    An id that has both labels counts as 0, one with several texts has the smallest. Of a text longer than fit_chars a
    piece of that length is taken where a hash of the id says. Labels other than 0 and 1 and null ids are left out. The
    driver takes FIT_FEATURES features at most, in order of the hash. Without labels all weights are 0.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    told = told.groupBy("id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    sample = told.filter("y = 0").orderBy("h", "id").limit(fit_docs).unionByName(told.filter("y = 1").orderBy("h", "id").limit(fit_docs))
    spare = F.greatest(F.length("text") - fit_chars, F.lit(0))
    piece = F.substring("text", (F.pmod(F.col("h"), spare + 1) + 1).cast("int"), F.lit(fit_chars))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = rows.join(F.broadcast(sample), "id").select("id", "h", "y", piece.alias("text")).groupBy("id", "h", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in shares([t.encode() for t in batch.column(3).to_pylist()]):
                first, at, value = features(part)
                cut = [slice(*first[k : k + 2]) for k in range(len(part))]
                packed = [pa.array([pack(x[s]) for s in cut], pa.binary()) for x in (at.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(done, len(part)) for k in (1, 2)] + packed, ["h", "y", "at", "value"])
                done += len(part)

    examples, size = [], 0
    for r in picked.mapInArrow(run, "h long, y int, at binary, value binary").orderBy("h", "y", "at").toLocalIterator():
        at = unpack(r["at"], np.int32)
        size += len(at)
        if size > FIT_FEATURES:
            break
        examples.append((np.append(at, 1 << BITS), np.append(unpack(r["value"], np.float32).astype(np.float64), 1.0), r["y"]))
    leader, rng = Leader(), np.random.default_rng(3)
    for _ in range(passes):
        for k in rng.permutation(len(examples)):
            leader.learn(*examples[k])
    return leader.weights()


def score_quality(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int) for each row, from its whole text alone.

    A null text reads as an empty one, whose score is the constant's. Repeated rows stay, equal texts get equal scores; other columns
    are not read; an empty table gives an empty result.
    """
    constant, used = float(weights[-1]), weights[:-1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in shares([(t or "").encode() for t in batch.column(1).to_pylist()]):
                first, at, value = features(part)
                sums = np.bincount(np.repeat(np.arange(len(part)), np.diff(first)), used[at] * value, minlength=len(part))
                score = 1 / (1 + np.exp(-np.clip(constant + sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])
                done += len(part)

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
