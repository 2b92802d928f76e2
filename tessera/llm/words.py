"""Tables of distinct words: texts are split block by block, each distinct word is worked on once, and results go back by position.

``streams`` has one row a block of documents: for every token the number of its word in the block.
``dictionaries`` has those words once a block, dealt to buckets by a hash, so that one bucket holds
all blocks' copies of a word and a frequent word counts once a block. What a bucket finds out goes
back under the block's numbers and ``rejoined`` meets it with the stream. Texts are never shuffled.

Both tables come from reading the documents twice, so the documents must come from a table, whose
rows read alike each time; blocks are named by their content, and a block whose words don't come
back raises ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, thrifty

#: Bytes of text in a block and in one step of splitting; a longer document makes a block of its own.
BLOCK_BYTES, STEP_BYTES = 12 << 20, 2 << 20
#: Words that are hashed in one step, so that only these stand beside their array.
HASHED = 1 << 14
#: Buckets for each shuffle partition.
BUCKETS = 2

Split = Callable[[bytes, np.ndarray], tuple[pa.Array, np.ndarray]]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def pack(values: np.ndarray) -> bytes:
    """Numbers, compressed with their bytes in planes."""
    flat = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_words(words: pa.Array) -> bytes:
    batch, sink = pa.record_batch([words], ["w"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_words(data: bytes) -> pa.Array:
    with pa.ipc.open_stream(data) as found:
        return found.read_all().column(0).combine_chunks()


def ascii_words(data: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes other than \\x20 and \\x09-\\x0D, A-Z lower-cased, and their number in each document.

    starts: where the documents begin in data, and len(data).
    """
    low = data.translate(_LOWER)
    full = ~_BLANK[np.frombuffer(low, np.uint8)]
    begin = np.zeros(len(full) + 1, bool)
    begin[starts] = True
    opens = np.flatnonzero(full & (begin[:-1] | ~np.concatenate([[False], full[:-1]])))
    closes = np.flatnonzero(full & (begin[1:] | ~np.concatenate([full[1:], [False]]))) + 1
    marks = np.empty(2 * len(opens) + 1, np.int64)
    marks[:-1:2], marks[1::2], marks[-1] = opens, closes, len(low)
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(opens), [None, pa.py_buffer(marks), pa.py_buffer(low)])
    return pieces.take(pa.array(np.arange(0, 2 * len(opens), 2))), np.diff(np.searchsorted(opens, starts))


def split_block(raws: list[bytes], split: Split) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each token's word, tokens of each document)."""
    chunks, counts, k = [], [], 0
    while k < len(raws):
        size, at = 0, k
        while k < len(raws) and (k == at or size + len(raws[k]) <= STEP_BYTES):
            size, k = size + len(raws[k]), k + 1
        words, n = split(b"".join(raws[at:k]), np.concatenate([[0], np.cumsum([len(x) for x in raws[at:k]])]))
        chunks.append(words)
        counts.append(n)
    coded = pa.chunked_array(chunks, pa.large_binary()).dictionary_encode().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.large_binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(counts).astype(np.int32) if counts else np.zeros(0, np.int32)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, list[bytes]]]:
    """(name, the rows without their texts, these as UTF-8; null: empty). A block's bytes are bounded, whatever batches the rows come in."""
    parts, raws, size = [], [], 0

    def block() -> tuple[str, pa.RecordBatch, list[bytes]]:
        (rows,), name = pa.Table.from_batches(parts).combine_chunks().to_batches(), xxhash.xxh3_128()
        for raw, key in zip(raws, rows.column(0).to_pylist(), strict=True):
            name.update(f"{key}:{len(raw)}:".encode() + raw)
        return name.hexdigest(), rows, raws

    for batch in batches:
        a, bare = 0, batch.set_column(1, batch.schema.field(1).name, pa.nulls(batch.num_rows))
        for k, raw in enumerate(batch.column(1)):
            raw = raw.as_py() or b""
            if raws and size + len(raw) > BLOCK_BYTES:
                parts += [bare.slice(a, k - a).take(pa.array(range(k - a)))] if k > a else []  # a slice would hold the whole batch
                yield block()
                parts, raws, size, a = [], [], 0, k
            raws.append(raw)
            size += len(raw)
        parts += [bare.slice(a).take(pa.array(range(len(bare) - a)))] if len(bare) > a else []
    if raws:
        yield block()


def _picked(df: DataFrame, id_col: str, text_col: str, flag: object) -> DataFrame:
    return small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"), F.lit(flag).cast("boolean").alias("flag"))


def streams(df: DataFrame, id_col: str, text_col: str, split: Split, flag: object = False) -> DataFrame:
    """(block, ids array, flags, counts, codes): one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part, raws in text_blocks(batches):
            _, codes, counts = split_block(raws, split)
            ids = pa.ListArray.from_arrays(pa.array([0, len(raws)], pa.int32()), part.column(0))
            flags = np.array([bool(x) for x in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([name]), ids, *(pa.array([pack(x)], pa.binary()) for x in (flags, counts, codes))], ["block", "ids", "flags", "counts", "codes"])

    kind = df.schema[id_col].dataType.simpleString()
    return _picked(df, id_col, text_col, flag).mapInArrow(thrifty(run), f"block string, ids array<{kind}>, flags binary, counts binary, codes binary")


def buckets(df: DataFrame) -> int:
    return BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dictionaries(df: DataFrame, id_col: str, text_col: str, split: Split, n_buckets: int, flag: object = False) -> DataFrame:
    """(bucket, block, codes, words, flagged): the distinct words of a block that fall into a bucket; flagged counts tokens in documents with the flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part, raws in text_blocks(batches):
            words, codes, counts = split_block(raws, split)
            flags = np.array([bool(x) for x in part.column(2).to_pylist()])
            flagged = np.bincount(codes[np.repeat(flags, counts)], minlength=len(words)).astype(np.int64)
            home = bucket_of(words, n_buckets)
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order])) + 1
            rows = [(int(home[at[0]]), pack(at.astype(np.int32)), pack_words(words.take(pa.array(at))), pack(flagged[at])) for at in np.split(order, edges) if len(at)]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "codes", "words", "flagged"])

    return _picked(df, id_col, text_col, flag).mapInArrow(thrifty(run), "bucket int, block string, codes binary, words binary, flagged binary")


def plain(words: pa.Array) -> list[bytes]:
    """Words without nulls, cut from their buffer: to_pylist makes an object of Arrow's for each before."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset).tolist()
    data = words.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    return [data[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def word_hashes(words: pa.Array) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for a in range(0, len(words), HASHED):
        out[a : a + HASHED] = [xxhash.xxh3_64_intdigest(w) for w in plain(words.slice(a, HASHED))]
    return out


def bucket_of(words: pa.Array, n_buckets: int) -> np.ndarray:
    return (word_hashes(words) % np.uint64(n_buckets)).astype(np.int64)


def together(blobs: list[bytes]) -> tuple[pa.Array, list[np.ndarray]]:
    """(distinct words of a bucket's rows, for each row the distinct words' numbers)."""
    parts = [unpack_words(x) for x in blobs]
    coded = pa.chunked_array([p for p in parts], pa.large_binary()).dictionary_encode().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(p) for p in parts])[:-1])


def rejoined(stream: DataFrame, replies: DataFrame, finish: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """finish(stream row, the block's replies) for each row of stream; replies has a column block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.to_pylist()
        return pa.concat_tables([finish(row, found) for row in left.to_pylist()])

    left = stream.groupBy("block")
    return left.cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: run(a, b) if a.num_rows else _nothing(schema), schema)


def _nothing(schema: str) -> pa.Table:
    raise ValueError("a block's words came back without its documents: the documents didn't read alike twice")


def placed(n: int, replies: list[dict], name: str, dtype: type) -> np.ndarray:
    """One value for each of a block's n words."""
    out, seen = np.zeros(n, dtype), np.zeros(n, bool)
    for row in replies:
        at = unpack(row["codes"], np.int32)
        out[at], seen[at] = unpack(row[name], dtype), True
    if not seen.all():
        raise ValueError("words of a block didn't come back: the documents didn't read alike twice")
    return out
