"""Media columns: PNG files in a binary column, written, checked, unfiltered and hashed by low frequencies.

``encode_png`` stores a payload as an 8-bit grey PNG, ``decode_png`` parses any non-interlaced
8-bit grey PNG: every chunk's CRC is tested, the zlib stream inflated and all five row filters
undone in numpy. ``dct_hash`` takes the signs of the lowest cosine-transform coefficients against
their median. Both steps are per row, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 16
HASH_SIDE, GRID = 8, 32


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """raw with bytes 0 up to a positive multiple of unit."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """An 8-bit grey PNG of the payload, whose length is a positive multiple of width.

    The row filter (none, sub or up) with the smallest sum of absolute differences serves the whole image.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    options = (rows, sub, up)
    kind = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum() for x in options]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = options[kind]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[k : k + IDAT_BYTES]) for k in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _pixelwise(line: np.ndarray, prior: np.ndarray, kind: int) -> np.ndarray:
    """Average (3) and Paeth (4): each pixel needs its restored left neighbour."""
    out, left, corner = bytearray(line.tobytes()), 0, 0
    for k, above in enumerate(prior.tolist()):
        if kind == 3:
            guess = (left + above) // 2
        else:
            p = left + above - corner
            near = (abs(p - left), abs(p - above), abs(p - corner))
            guess = left if near[0] <= near[1] and near[0] <= near[2] else above if near[1] <= near[2] else corner
        left, corner = (out[k] + guess) & 255, above
        out[k] = left
    return np.frombuffer(bytes(out), np.uint8)


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (filter byte first); runs of rows with one filter are undone together."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    starts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(lines)]])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        kind = int(kinds[a])
        prior = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            out[a] += prior
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for k in range(a, b):
                prior = out[k] = _pixelwise(out[k], prior, kind)
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Rows of samples. ValueError on a bad signature, checksum, order, size or format."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey without interlace is read")
            size = (height, width)
        elif kind == b"IDAT":
            packed.append(data)
        ended, at = kind == b"IEND", at + 12 + n
    if size is None or not ended:
        raise ValueError("PNG without header or end")
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("PNG of a wrong size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


def _cosines(side: int, grid: int) -> np.ndarray:
    k, x = np.arange(side)[:, None], np.arange(grid)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * grid))


_DCT = _cosines(HASH_SIDE, GRID)


def _shrink(image: np.ndarray, grid: int = GRID) -> np.ndarray:
    """grid x grid means over all samples; sides under grid repeat theirs."""
    for axis in (0, 1):
        n = image.shape[axis]
        edges = np.arange(grid) * n // grid
        if n >= grid:
            counts = np.diff(np.append(edges, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            image = np.add.reduceat(image, edges, axis=axis, dtype=np.float64) / counts
        else:
            image = np.take(image, edges, axis=axis)
    return image


def dct_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine coefficients exceed the median without the mean's."""
    low = np.round(np.einsum("ki,ij,lj->kl", _DCT, _shrink(image), _DCT, optimize=True).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """(id, n_bytes long, media binary) for each row: the whole text as UTF-8, padded, as a PNG.

    A null text counts as empty (one row of zeros). Repeated rows stay; other columns are not read;
    an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                raws = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array([encode_png(pad(x), level=level) for x in raws], pa.binary())], ["id", "n_bytes", "media"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return picked.mapInArrow(run, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from stored files.

    n_bytes passes through. A null file gives nulls; a damaged one raises ValueError.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        image = decode_png(media)
        payload = image.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                found = [one(x) for x in part.column(2).to_pylist()]
                cols = [pa.array([x[k] for x in found], kind) for k, (_, kind) in enumerate(fields[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["id", *(n for n, _ in fields)])

    picked = df.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))
    schema = f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
