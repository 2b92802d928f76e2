"""N-gram Jaccard join by prefix trees, and the components that its links make.

A text's set holds the hashes of its distinct word n-grams. The join goes in four steps:

1. Count, for every text, the n-grams that another text holds too. Two texts that link share at
   least ``share`` of either, so a text with fewer shared n-grams links with nothing.
2. One text of each set stays; n-grams are ordered globally, rare ones first, and those of one text alone go.
3. Texts that link share an n-gram among the first ones of this order. Under each such n-gram the
   smallest id is the pivot, and every text is tested against its pivots. Texts of one component need
   no more tests. Where an n-gram's texts lie in several components, those outside the pivot's are
   tested against all of its other texts from other components.
4. A test puts the sets in a trie by the global order and walks it with the pivot's set: sets with the
   same beginning share their partial overlap, and a subtree is left as soon as what remains can't reach
   the overlap needed.

Links within a component need not all be found, but no two components stay apart that a link joins.
N-grams travel packed, one row a block of texts and bucket of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join, split_pairs
from .common import removed, small_batches, thrifty, written
from .words import ascii_words, pack, split_block, text_blocks, unpack

#: Buckets of hashes for each shuffle partition; texts in one walk of a trie; nodes between two looks at the bound.
BUCKETS, TRIE_SETS, STRIDE = 8, 256, 64
NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(raws: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct n-grams as sorted 64-bit hashes. Fewer words than ``words`` make one n-gram, none an empty set."""
    distinct, codes, counts = split_block(raws, ascii_words)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
    tokens, ends = own[codes], np.cumsum(counts)
    n = max(0, len(tokens) - words + 1)
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            grams = _mixed(grams * _ODD + tokens[k : k + n])
        out = []
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for t in tokens[a:b]:
                    h = _mixed(h * _ODD + t)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _dealt(name: str, sets: list[np.ndarray], n_buckets: int, keep: type) -> pa.RecordBatch:
    """Rows (bucket, block, owners, hashes) of a block's sets; ``keep`` is the hashes' type."""
    sizes = np.array([len(s) for s in sets])
    every, owners = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
    home = ((every >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order])) + 1
    rows = [(int(home[at[0]]), pack(owners[at]), every[at].astype(keep).tobytes()) for at in np.split(order, edges) if len(at)]
    cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "block", "owners", "hashes"])


DEALT = "bucket int, block string, owners binary, hashes binary"


def _frequencies(group: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(hashes, in how many sets each is, where the rows begin) of a bucket."""
    parts = [np.frombuffer(x, kind) for x in group.column("hashes").to_pylist()]
    every = np.concatenate(parts)
    _, which, n = np.unique(every, return_inverse=True, return_counts=True)
    return every, n[which], np.cumsum([0, *map(len, parts)]).tolist()


def shared_counts(df: DataFrame, words: int, n_buckets: int) -> DataFrame:
    """(id, n, digest of the set, md5 of the text, n_shared) of each row of (id, raw); n_shared may count a few hashes that only look alike."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part, raws in text_blocks(batches):
            sets = shingle_sets(raws, words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) + hashlib.md5(raw).digest() for s, raw in zip(sets, raws, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([np.array(list(map(len, sets)), np.int64).tobytes()]), pa.array([b"".join(digests)])], ["block", "ids", "sizes", "digests"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, raws in text_blocks(batches):
            yield _dealt(name, shingle_sets(raws, words), n_buckets, np.uint32)

    def count(group: pa.Table) -> pa.Table:
        _, n, edges = _frequencies(group, np.uint32)
        found = []
        for owners, a, b in zip(group.column("owners").to_pylist(), edges[:-1], edges[1:], strict=True):
            sums = np.bincount(unpack(owners, np.uint32)[n[a:b] > 1])
            at = np.flatnonzero(sums).astype(np.int32)
            found.append((pack(at), pack(sums[at].astype(np.int32))))
        return pa.table({"block": group.column("block").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "at": pa.array([f[0] for f in found], pa.binary()), "n": pa.array([f[1] for f in found], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            ids, sizes, digests = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), row["digests"]
            sums = np.zeros(len(ids), np.int64)
            for r in {r["bucket"]: r for r in right.to_pylist()}.values():
                sums[unpack(r["at"], np.int32)] += unpack(r["n"], np.int32)
            out.append(pa.table({"id": ids, "n": sizes, "digest": pa.array([digests[32 * k : 32 * k + 16] for k in range(len(ids))], pa.binary()), "md5": pa.array([digests[32 * k + 16 : 32 * k + 32].hex() for k in range(len(ids))]), "n_shared": sums}))
        if not out:
            raise ValueError("a block's n-grams came back without its texts: the texts didn't read alike twice")
        return pa.concat_tables(out)

    counts = df.mapInArrow(thrifty(deal), DEALT).groupBy("bucket").applyInArrow(count, "block string, bucket int, at binary, n binary")
    left = df.mapInArrow(thrifty(blocks), "block string, ids binary, sizes binary, digests binary")
    return left.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(finish, "id long, n long, digest binary, md5 string, n_shared long")


def ordered_sets(sets: DataFrame, n_buckets: int, least: float) -> DataFrame:
    """(id, n, keys): the n-grams that two or more of the sets (id, n, hashes) hold, as numbers in global order, rare ones first.

    Sets that share less than ``least`` of their n-grams go. A number's top bits are the frequency's
    logarithm, the rest are the hash's.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part, name = batch.slice(k, 2048), xxhash.xxh3_128()
                for key, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    name.update(f"{key}:".encode() + x)
                yield name.hexdigest(), part

    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([part.column(k).to_numpy().astype(np.int64).tobytes()]) for k in (0, 1))], ["block", "ids", "sizes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in runs(batches):
            yield _dealt(name, [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()], n_buckets, np.uint64)

    def rank(group: pa.Table) -> pa.Table:
        hashes, n, edges = _frequencies(group, np.uint64)
        keys = ((4 * np.log2(n)).astype(np.uint64) << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1))
        found = []
        for owners, a, b in zip(group.column("owners").to_pylist(), edges[:-1], edges[1:], strict=True):
            two = n[a:b] > 1
            found.append((pack(unpack(owners, np.uint32)[two]), keys[a:b][two].tobytes()))
        return pa.table({"block": group.column("block").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "owners": pa.array([f[0] for f in found], pa.binary()), "keys": pa.array([f[1] for f in found], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
            got = list({r["bucket"]: r for r in right.to_pylist()}.values())
            owners = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["owners"], np.uint32) for r in got)])
            keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in got)])
            order = np.lexsort((keys, owners))
            ends = np.cumsum(np.bincount(owners, minlength=len(ids)))
            keys, lists = keys[order], []
            for k, (b, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                a = int(ends[k - 1]) if k else 0
                lists.append(keys[a:b].tobytes() if b - a >= least * n - 1e-9 else None)
            out.append(pa.table({"id": ids, "n": sizes, "keys": pa.array(lists, pa.binary())}))
        return pa.concat_tables(out)

    ranks = sets.mapInArrow(thrifty(deal), DEALT).groupBy("bucket").applyInArrow(rank, "block string, bucket int, owners binary, keys binary")
    left = sets.mapInArrow(thrifty(meta), "block string, ids binary, sizes binary")
    out = left.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(finish, "id long, n long, keys binary")
    return out.filter("keys is not null")


def walk_trie(query: np.ndarray, n_query: int, sets: list[tuple[int, int, np.ndarray]], percent: int) -> list[int]:
    """Ids of the sets (id, size, keys) whose Jaccard similarity with the query is percent / 100 or more.

    The sets, sorted by their keys, are the trie in depth-first order: what a set has in common with
    the one before is the shared path, whose overlap is kept.
    """
    out, before, met, seen = [], np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for ident, n, keys in sorted(sets, key=lambda s: s[2].byteswap().tobytes()):
        size = min(len(before), len(keys))
        apart = np.flatnonzero(before[:size] != keys[:size])
        depth = min(int(apart[0]) if len(apart) else size, seen)
        before, need = keys, -(-percent * (n + n_query) // (100 + percent))
        path, overlap = [met[:depth]], int(met[depth - 1]) if depth else 0
        while True:
            rest = len(query) - int(np.searchsorted(query, keys[depth - 1], "right")) if depth else len(query)
            if overlap + min(len(keys) - depth, rest) < need or depth == len(keys):
                break
            step = keys[depth : depth + STRIDE]
            at = np.minimum(np.searchsorted(query, step), len(query) - 1)
            path.append(overlap + np.cumsum(query[at] == step))
            depth, overlap = depth + len(step), int(path[-1][-1])
        met, seen = np.concatenate(path), depth
        if depth == len(keys) and overlap >= need:
            out.append(ident)
    return out


def tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that link. pairs: distinct (a, b); b's set is walked against the trie of its a's."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(TRIE_SETS)).cast("int").alias("salts"))
    salted = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    members = salted.join(sets.select(F.col("id").alias("a"), "n", "keys"), "a").select("b", "salt", F.lit(1).alias("role"), F.col("a").alias("id"), "n", "keys")
    pivots = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(sets.select(F.col("id").alias("b"), "n", "keys"), "b")
    both = members.unionByName(pivots.select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("id"), "n", "keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, query, held = None, None, []

        def links() -> pa.RecordBatch:
            found = walk_trie(query[2], query[1], held, percent) if query is not None and held else []
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([home[0] if home else 0] * len(found), pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for b, salt, role, ident, n, keys in zip(*cols, strict=True):
                if (b, salt) != home:
                    yield links()
                    home, query, held = (b, salt), None, []
                row = (ident, n, np.frombuffer(keys, np.uint64))
                if role:
                    held.append(row)
                else:
                    query = row
        yield links()

    return both.repartition("b", "salt").sortWithinPartitions("b", "salt", "role").mapInArrow(thrifty(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b); component is the smallest id reachable. Large and small stars in turn, each round a written table."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (mark["n"], mark["h"]):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        state, total = (mark["n"], mark["h"]), mark["n"]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = written(split_join(both, least, ["a"], "n", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = split_join(large, low, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(low.select("a", F.col("m").alias("b")))
        before, now = now, written(small.distinct(), "edges")
        removed(before, large)


def grown(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all ordered sets that link with another."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lead = []
            for n, x in zip(ns, batch.column(2).to_pylist(), strict=True):
                keys = np.frombuffer(x, np.int64)
                lead.append(keys[: len(keys) - -(-percent * n // 100) + 1])
            sizes, whole = [len(x) for x in lead], [len(x) // 8 for x in batch.column(2).to_pylist()]
            rest = np.concatenate([w - np.arange(k) for w, k in zip(whole, sizes, strict=True)])
            cols = [np.concatenate(lead), *(np.repeat(np.array(x, np.int64), sizes) for x in (ids, ns)), rest, np.repeat(np.array(ns, np.int64) - np.array(whole, np.int64), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "id", "n", "rest", "alone"])

    # rest: how many of the text's n-grams come from this one on. Texts that link can make up the overlap
    # from the first n-gram that both have on, so pairs are dropped where that can't be.
    def reach(n: Column, rest: Column, m: Column, left: Column) -> Column:
        return F.lit(100 + percent) * F.least(rest, left) >= F.lit(percent) * (n + m)

    rows = sets.mapInArrow(thrifty(firsts), "gram long, id long, n long, rest long, alone long")
    # The pivot is the text with the smallest share of n-grams of its own, which is the nearest to most copies.
    pivots = rows.groupBy("gram").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "id", "n", "rest")).alias("p"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    pivots = written(pivots.select("gram", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.rest").alias("pivot_rest"), "many"), "pivots")
    total = pivots.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("n")).first()["n"]
    under = written(split_join(rows, pivots, ["gram"], "many", total), "grams")
    first = under.filter(F.col("id") != F.col("pivot")).filter(reach(F.col("n"), F.col("rest"), F.col("pivot_n"), F.col("pivot_rest"))).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = written(tested(first, sets, percent), "links")
    known = written(components(edges), "components")
    label = under.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    homes = pivots.select("gram", "pivot", "many").join(known.select(F.col("id").alias("pivot"), F.col("component").alias("home")), "pivot", "left").select("gram", F.coalesce("home", "pivot").alias("home"), "many")
    label = split_join(label.filter("id != pivot").select("gram", "id", "n", "rest", "component"), homes, ["gram"], "many", total)
    label = written(label, "labels")
    outside = label.filter("component != home").select("gram", F.col("id").alias("a"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("component").alias("ca"))
    apart = split_pairs(outside, label.drop("home"), "gram").filter((F.col("ca") != F.col("component")) & reach(F.col("n"), F.col("rest"), F.col("m"), F.col("left")))
    second = apart.select(F.greatest("a", "id").alias("a"), F.least("a", "id").alias("b")).distinct()
    more = written(tested(second, sets, percent), "links")
    out = components(edges.unionByName(more))
    removed(pivots, under, known, label, edges, more)
    return out


def jaccard_components(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(id long, n_shingles long, component_id long) for each row; with keys also component_key binary and text_md5 string.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of distinct word
    n-grams (words: runs of bytes other than blanks, A-Z lower-cased); component_id is the smallest id
    that links reach, the own one included. Fewer words than ``words`` make one n-gram. A null or empty
    text, or one of blanks, has an empty set and links with nothing. Texts with equal sets link, also
    repeated rows; a repeated id with another text is a text of its own. A null id takes part: its
    component is the smallest id reached, or null where there is none. component_key names the component also
    where ids are null or repeated (null for an empty set). Other columns are not read; an
    empty table gives an empty result. df must be a table, which reads alike each time. Hashes have 64
    bits, those of whole sets 128, of which 64 name the set in the join.
    """
    spark = df.sparkSession
    n_buckets, least = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), percent / 100
    picked = small_batches(df).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    base = written(shared_counts(picked, words, n_buckets), "texts")
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    classes = written(base.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.min_by("md5", "id").alias("md5"), F.min(own).alias("first"), F.max(F.col("n_shared") >= least * F.col("n") - 1e-9).alias("alive"), F.count(F.lit(1)).alias("many")), "classes")
    alive = classes.filter("alive").select("id", "md5").distinct()
    keyed = picked.withColumn("md5", F.md5(F.coalesce("raw", F.lit("").cast("binary"))))
    texts = keyed.join(alive, ["id", "md5"]).select("raw")  # broadcast or not, as the size of the written ids allows

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                found = [s.tobytes() for s in shingle_sets([x or b"" for x in batch.slice(k, 512).column(0).to_pylist()], words)]
                yield pa.RecordBatch.from_arrays([pa.array([node(xxhash.xxh3_128_digest(s)) for s in found], pa.int64()), pa.array([len(s) // 8 for s in found], pa.int64()), pa.array(found, pa.binary())], ["id", "n", "hashes"])

    sets = written(texts.mapInArrow(thrifty(build), "id long, n long, hashes binary"), "sets")
    count = sets.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("one")).first()
    ordered = written(ordered_sets(sets if count["n"] == count["one"] else sets.dropDuplicates(["id"]), n_buckets, least), "ordered")
    linked = grown(ordered, percent)
    name = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    nodes = classes.select("digest", "first", "many", name.alias("node")).join(linked.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = nodes.groupBy("component").agg(F.min("first").alias("component_id"), F.min("digest").alias("component_key"), F.count(F.lit(1)).alias("n"))
    totals = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("many"), F.lit(0)).alias("rows")).first()
    found = written(split_join(nodes.select("digest", "many", "component"), sums, ["component"], "n", totals["n"]).select("digest", "many", "component_id", "component_key"), "found")
    removed(sets, ordered, classes)
    # Texts without n-grams meet nothing and need no join.
    held = split_join(base.filter("n > 0"), found, ["digest"], "many", totals["rows"])
    none = base.filter("n = 0").withColumn("component_id", F.lit(None).cast("long")).withColumn("component_key", F.lit(None).cast("binary"))
    more = ["component_key", F.col("md5").alias("text_md5")] if keys else []
    return held.unionByName(none).select(own.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"), *more)


def node(digest: bytes) -> int:
    """A set's number in the join."""
    return int.from_bytes(digest[:8], "big", signed=True)
