"""Clustering and codes of vectors against plain Python; the quality classifier against a plain learner and held-out labels."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import centroids, codes, quality, vectors
from tessera.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, id string, cluster string, code string, n int, __label string, vec string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(k, v, label, "i", "c", "x", 1, "l", "v") for k, v, label in rows], SCHEMA).repartition(3)


def odd_rows(dim, seed, n=150):
    """Repeated rows, repeated ids, null ids and labels, ties, zero and huge vectors, unusable and other lengths."""
    rng = random.Random(seed)
    rows = [(rng.randrange(1000), [rng.gauss(0, 0.3) for _ in range(dim)], rng.choice((0, 1, 1, None))) for _ in range(n)]
    rows += [(k, [round(x) / 64 for x in v], label) for k, v, label in rows[:20]] + rows[:15] * 3 + [(k, v, 7) for k, v, _ in rows[:5]]
    rows += [(None, rows[0][1], None), (-5, [0.0] * dim, 1), (-6, [0.0] * dim, 1), (2000, [1e300] * dim, 3), (2001, [-1e300] + [0.0] * (dim - 1), 3)]
    return rows + [(1, None, 1), (2, [], 1), (3, [NAN] * dim, 1), (4, [INF] + [0.0] * (dim - 1), 1), (5, [None] + [0.0] * (dim - 1), 1), (6, [0.5] * (dim // 2), 1)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    most = math.isqrt((1 << 62) // len(v)) // 2
    return [max(-most, min(most, math.floor(x * scale) if abs(x) < 1e200 else int(math.copysign(1 << 80, x)))) for x in v]


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def mean(rows):
    return [sum(x) // len(rows) for x in zip(*rows)]


def test_clusters_equal_plain_python(spark):
    dim, k = 6, 9
    rows = odd_rows(dim, 3)
    kept = [(i, whole(v, 64), v) for i, v, _ in rows if usable(v) and len(v) == dim]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    cents = [x for _, x, _ in start]
    nearest = lambda x: min((away(x, c), j) for j, c in enumerate(cents))
    for _ in range(3):
        home = collections.defaultdict(list)
        for _, x, _ in kept:
            home[nearest(x)[1]].append(x)
        cents = [mean(home[j]) if home[j] else c for j, c in enumerate(cents)]
    last = [(i, *nearest(x)) for i, x, _ in kept]
    sums, top = collections.Counter(), (1 << 63) - 1
    for _, d, j in last:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    want = collections.Counter((i, j, d, min(sums[j], top), min(sum(sums.values()), top), sha[j]) for i, d, j in last)
    assert collections.Counter(tuple(r) for r in centroids.cluster(table(spark, rows), k=k, dim=dim).collect()) == want
    few = [r for r in rows if usable(r[1]) and len(r[1]) == dim][:3]
    assert {r["distance"] for r in centroids.cluster(table(spark, few), k=k, dim=dim).collect()} == {0}
    assert centroids.cluster(table(spark, rows).filter("n = 2"), dim=dim).count() == 0


def test_annuli_hold_every_nearest_centroid():
    """Boundary ties, equal norms and far vectors: the ranges hold all nearest centroids and leave most others out."""
    rng = np.random.default_rng(2)
    cents = np.concatenate([rng.integers(-40, 40, (30, 4)) * rng.integers(1, 60, (30, 1)), [[3, 0, 0, 0], [0, 3, 0, 0], [9, 0, 0, 0], [3, 0, 0, 0]]]).astype(np.int64)
    x = np.concatenate([rng.integers(-3000, 3000, (500, 4)), [[6, 0, 0, 0], [0, 0, 0, 0], [3, 3, 0, 0]], cents]).astype(np.int64)
    search = centroids.Annuli(cents)
    low, high = search.candidates(x)
    far = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    for row, (a, b) in enumerate(zip(low, high)):
        assert set(np.flatnonzero(far[row] == far[row].min())) <= set(search.order[a:b].tolist())
    low_near, high_near = search.candidates(np.repeat(cents, 5, axis=0) + rng.integers(-3, 4, (5 * len(cents), 4)))
    assert (high_near - low_near).mean() < len(cents) / 2
    number, best = search.nearest(x)
    assert (best == far.min(axis=1)).all() and (number == far.argmin(axis=1)).all()


def codes_by_hand(rows, dim, parts, entries, rounds=2):
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = sorted((r for r in rows if usable(r[1])), key=order)
    fit = [(i, whole(v, 256), label) for i, v, label in kept if len(v) == dim]
    width = dim // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in fit[:entries]] for p in range(parts)]
    nearest = lambda x, p: min((away(cut(x, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        home = collections.defaultdict(list)
        for _, x, _ in fit:
            for p in range(parts):
                home[p, nearest(x, p)[1]].append(cut(x, p))
        books = [[mean(home[p, e]) if home[p, e] else c for e, c in enumerate(books[p])] for p in range(parts)]
    out = [(i, "".join(f"{nearest(x, p)[1]:02x}" for p in range(parts)), sum(nearest(x, p)[0] for p in range(parts)), label) for i, x, label in fit]
    out += [(i, None, None, label) for i, v, label in kept if len(v) != dim]
    sums = collections.Counter()
    for _, _, e, label in out:
        sums[label] += e or 0
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return collections.Counter((i, code, e, min(sums[label], (1 << 63) - 1), digest) for i, code, e, label in out)


@pytest.mark.parametrize("hot", [256, 2])
def test_codes_equal_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr("tessera.operators.skew.HOT_LEAST", hot)
    rows = odd_rows(12, 5)
    got = collections.Counter(tuple(r) for r in codes.compress(table(spark, rows), parts=4, entries=10).collect())
    assert got == codes_by_hand(rows, 12, 4, 10)
    assert codes.compress(table(spark, rows).filter("n = 2"), parts=4).count() == 0


def test_screening_keeps_every_nearest_entry():
    """Entries far from the origin and close together, where single precision can't tell them apart."""
    rng = np.random.default_rng(4)
    for offset in (0, 1 << 12, 1 << 20, 1 << 26):
        entries = offset + rng.integers(-3, 4, (64, 4))
        x = offset + rng.integers(-4, 5, (300, 4))
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        held = codes.screened(x, entries)
        assert (held | (far > far.min(axis=1, keepdims=True))).all()
        index, best = codes.nearest_entry(x, entries)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    assert codes.screened(rng.integers(-90, 90, (500, 4)), rng.integers(-90, 90, (64, 4))).sum() < 700


def test_integers_floor_and_stay_in_bounds():
    flat = np.array([-0.001, 0.001, -1.0, 1e308, -1e308, 0.0])
    got = vectors.integers(flat, 2, 64).ravel().tolist()
    assert got[:3] == [-1, 0, -64] and got[3:5] == [vectors.bound(2), -vectors.bound(2)] and 2 * (2 * vectors.bound(2)) ** 2 <= 1 << 62


TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00\x20\x09-\x0D]+")


def plain_features(text):
    words = TOKEN.findall((text or "").encode())
    mix = lambda h: int(quality.mixed(np.array([h & (1 << 64) - 1], np.uint64))[0])
    repeat, found = int(quality._REPEAT), collections.Counter()
    for seed, view in ((1, bytes.lower), (2, quality.form)):
        h = [xxhash.xxh3_64_intdigest(view(w), seed) for w in words]
        keys = h + [repeat if seed == 1 and a == b else mix(a + 3) + b for a, b in zip(h, h[1:])]
        found.update(mix(k) >> 64 - quality.BITS for k in keys)
    size = math.sqrt(sum(math.log1p(n) ** 2 for n in found.values()))
    return {k: math.log1p(n) / size for k, n in sorted(found.items())}


TEXTS = ["", None, "one", "One one ONE, two!! two!!", "a *** b&&& 12 x9 \x00 Ünïcode 漢字 漢字", "\n\t ", "!!!", "w " * 30_000, "x" * 300_000, " ".join(f"w{k}" for k in range(5000))]


def test_quality_features_equal_plain_python():
    first, at, value = quality.features([(t or "").encode() for t in TEXTS])
    for k, text in enumerate(TEXTS):
        want, s = plain_features(text), slice(first[k], first[k + 1])
        assert at[s].tolist() == list(want) and np.allclose(value[s], list(want.values()))


def test_quality_learner_and_scores(spark):
    """Weights by a plain learner over the same order; scores by dictionaries; rows that can't be learnt from change nothing."""
    rng = random.Random(6)
    texts = TEXTS[:7] + [" ".join(rng.choice(["Good", "fine", "bad!!", "the", "of", "***"]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    docs = [(k, t, "en", 1, 2) for k, t in enumerate(texts)] + [(None, "bad!!", "en", 1, 2), (9, texts[9], "en", 1, 2)]
    labels = [(k, int("bad" not in (t or ""))) for k, t in enumerate(texts)] + [(12, 0), (None, 1), (500, 1), (13, None), (14, 3), (10, int("bad" not in texts[10]))]
    df = spark.createDataFrame(docs, "doc_id long, text string, h string, y int, at int").repartition(3)
    weights = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    told = {}
    for k, y in labels:
        if k in range(len(texts)) and y in (0, 1):
            told[k] = min(y, told.get(k, 1))
    order = {r["k"]: r["h"] for r in spark.createDataFrame([(k,) for k in told], "k long").selectExpr("k", "xxhash64(cast(k as string)) h").collect()}
    examples = [({**plain_features(texts[k]), -1: 1.0}, told[k]) for k in sorted(told, key=lambda k: order[k])]
    z, n, shuffle = collections.Counter(), collections.Counter(), np.random.default_rng(3)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))

    for _ in range(quality.PASSES):
        for k in shuffle.permutation(len(examples)):
            x, y = examples[k]
            p, w = chance(x), {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.score_quality(df, weights).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d[0] for d in docs)
    by_id = dict((k, t) for k, t, *_ in docs)
    for r in got:
        want = chance({**plain_features(by_id[r["doc_id"]]), -1: 1.0})
        assert abs(r["score"] - want) < 1e-3 and r["predicted"] == (r["score"] >= 0.5)
    empty = df.filter("doc_id = -1")
    assert quality.score_quality(empty, weights).count() == 0
    assert {r["score"] for r in quality.score_quality(df, quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no table")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op13_quality"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(pairs) > 1000 and sum(p == y for p, y in pairs) / len(pairs) > 0.99
    assert sum(p == 1 for p, y in pairs if y == 0) / sum(y == 0 for _, y in pairs) < 0.05
