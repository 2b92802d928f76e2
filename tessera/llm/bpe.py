"""Byte-level BPE through a table of distinct words.

Texts are split into words block by block (``gpt_words``), each distinct word is encoded once in its
bucket by the tokenizers library, and the ids go back by position. Decoding joins ids with the
table of id and piece, which the vocabulary bounds and every worker therefore holds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buckets, dictionaries, pack, placed, rejoined, streams, together, unpack

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_KINDS: dict[str, np.ndarray] = {}


def kinds(points: np.ndarray, path: str) -> np.ndarray:
    """Each code point's kind. New ones are tried on the file's own pre-tokenizer, whose Unicode version then holds."""
    table = _KINDS.setdefault(path, np.full(0x110000, UNKNOWN, np.uint8))
    table[32] = SPACE
    found = table[points]
    if (new := np.unique(points[found == UNKNOWN]).tolist()) or UNKNOWN in found:
        probe = "".join(f"x{chr(c)}1!{chr(c)}!" for c in new)
        begun = {span[0] for _, span in tokenizer(path).pre_tokenizer.pre_tokenize_str(probe)}
        for k, c in enumerate(new):
            at = 6 * k
            table[c] = LETTER if at + 1 not in begun else NUMBER if at + 2 not in begun else SPACE if at + 4 in begun and at + 5 in begun else OTHER
        found = table[points]
    return found


def gpt_words(data: bytes, starts: np.ndarray, path: str, special: tuple[bytes, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """Words of byte-level BPE and their number in each document; they cover every byte.

    A word is a run of letters, of numbers or of other signs, with one blank before it if there is one;
    an English contraction after an apostrophe; or a run of white space, without its last character
    where a word follows. Strings of ``special`` are words of their own.
    """
    if not data:
        return pa.array([], pa.large_binary()), np.zeros(len(starts) - 1, np.int64)
    lead = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((lead & 0xC0) != 0x80)  # bytes where characters begin
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    kind, n = kinds(points, path), len(points)
    fresh = np.zeros(n + 1, bool)  # characters where splitting starts anew
    fresh[np.searchsorted(at, starts)] = True
    inner = []
    for s in special:
        k = data.find(s)
        while k >= 0:
            a, b = np.searchsorted(at, [k, k + len(s)])
            if np.searchsorted(starts, k, "right") == np.searchsorted(starts, k + len(s) - 1, "right"):
                fresh[[a, b]] = True
                inner.append((a, b))
                k += len(s) - 1
            k = data.find(s, k + 1)
    fresh[0] = fresh[n] = True
    run = fresh.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    begin = run.copy()
    solid = np.flatnonzero(run[1:n] & (kind[1:] != SPACE) & ~fresh[1:n] & (kind[:-1] == SPACE)) + 1
    begin[solid - 1] = True
    begin[solid[points[solid - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & begin[:n])
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~fresh[quote + 1]]
    get = lambda k: np.where(k < n, points[np.minimum(k, n - 1)], 0)
    one, two = get(quote + 1), np.where(fresh[np.minimum(quote + 2, n)], 0, get(quote + 2))
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for which, size in ((quote[short], 2), (quote[long], 3)):
        begin[which + 1] = False
        begin[which + size] = True
    for a, b in inner:
        begin[a + 1 : b] = False
    marks = np.flatnonzero(begin[:n])
    offsets = np.append(at[marks], len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(offsets[:-1], starts))


def special_strings(path: str) -> tuple[bytes, ...]:
    with open(path) as f:
        return tuple(x["content"].encode() for x in json.load(f)["added_tokens"])


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str) -> object:
    """The vocabulary file's tokenizer with truncation and padding off, read once a worker."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _TOKENIZERS[path] = found
    return _TOKENIZERS[path]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pieces(path: str) -> list[bytes]:
    """The bytes of each id, by id."""
    letters = {c: b for b, c in byte_letters().items()}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        out[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text, as the tokenizers library encodes it without adding special tokens.

    A null or empty text has no ids. Repeated rows stay, also those with equal or null ids; other
    columns are not read; an empty table gives an empty result. df must be a table (see words.py).
    """
    special, n = special_strings(path), buckets(df)
    split = lambda data, starts: gpt_words(data, starts, path, special)

    def encode(group: pa.Table) -> pa.Table:
        words, numbers = together(group.column("words").to_pylist())
        coder, letters, ids, sizes = tokenizer(path).model, byte_letters(), [], []
        fixed = {x: tokenizer(path).token_to_id(x.decode()) for x in special}
        for w in words.to_pylist():
            found = [fixed[w]] if w in fixed else [x.id for x in coder.tokenize(w.decode("latin-1").translate(letters))]
            ids += found
            sizes.append(len(found))
        size, flat = np.array(sizes, np.int32), np.array(ids, np.uint32)
        first, rows = np.cumsum(size) - size, []
        for own in numbers:
            rows.append((pack(size[own]), pack(flat[spread(first[own], size[own])])))
        return pa.table({"block": group.column("block").combine_chunks(), "codes": group.column("codes").combine_chunks(), "sizes": pa.array([r[0] for r in rows], pa.binary()), "ids": pa.array([r[1] for r in rows], pa.binary())})

    kind = df.schema[id_col].dataType

    def finish(row: dict, replies: list[dict]) -> pa.Table:
        codes, counts = unpack(row["codes"], np.int32), unpack(row["counts"], np.int32)
        n_words = int(codes.max()) + 1 if len(codes) else 0
        size = placed(n_words, replies, "sizes", np.int32)
        first, flat = np.zeros(n_words, np.int64), []
        base = 0
        for r in replies:
            own = unpack(r["sizes"], np.int32)
            first[unpack(r["codes"], np.int32)] = base + np.cumsum(own) - own
            flat.append(unpack(r["ids"], np.uint32))
            base += len(flat[-1])
        ids = np.concatenate(flat)[spread(first[codes], size[codes])] if flat else np.zeros(0, np.uint32)
        tokens = np.concatenate([[0], np.cumsum(size[codes])])[np.concatenate([[0], np.cumsum(counts)])]
        lists = pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(ids.view(np.int32)))
        return pa.table({"id": pa.array(row["ids"], to_arrow(kind)), "ids": lists})

    replies = dictionaries(df, id_col, text_col, split, n).groupBy("bucket").applyInArrow(encode, "block string, codes binary, sizes binary, ids binary")
    out = rejoined(streams(df, id_col, text_col, split), replies, finish, f"id {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def to_arrow(kind: object) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of the next."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _decoded(ids: pa.ListArray, table: pa.Array) -> Iterator[bytes]:
    """The joined pieces of each row's ids."""
    flat = table.take(ids.flatten())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data, edges = flat.buffers()[2] if len(flat) else b"", ids.offsets.to_numpy() - ids.offsets[0].as_py()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield bytes(memoryview(data)[offsets[a] : offsets[b]]) if b > a else b""


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """df's id and ids with text: the ids' pieces joined, special tokens included; broken UTF-8 becomes U+FFFD.

    Null ids give a null text, none an empty one; an id outside the vocabulary raises an error.
    Repeated rows stay; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces(path), pa.large_binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [None if gone else x.decode(errors="replace") for x, gone in zip(_decoded(part.column(1), table), part.column(1).is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["id", "ids", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids as little-endian 32-bit integers, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces(path), pa.large_binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids = part.column(1)
                flat, edges = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
                own = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                back = [hashlib.sha256(x.decode(errors="replace").encode()).hexdigest() for x in _decoded(ids, table)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edges), pa.int64()), pa.array(own), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
