"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's bytes; a cut falls where its top bits are zero, so cuts depend on
the 16 bytes before them alone and fall back into step soon after an insertion. Chunks are compared
by a 128-bit digest over the whole corpus. Runs of neighbouring chunks that other documents hold
too are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import split_join
from .common import written

#: Hash bits (its window in bytes), zero bits at a cut, least and largest chunk in bytes.
WINDOW, CUT_BITS, LEAST, LARGEST = 16, 5, 24, 512
#: Shortest repeated run that is reported, in bytes: what chunks leave of fifty short words.
MIN_RUN = 64
GEAR = np.random.default_rng(20240501).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j under 16, modulo 2^16, by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            more = h[:-k] << np.uint16(k)
            h = h.copy()
            h[k:] += more
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks; the last is len(raw)."""
    n = len(raw)
    marks = (np.flatnonzero(gear_hash(np.frombuffer(raw, np.uint8)) < (1 << (WINDOW - CUT_BITS))) + 1).tolist() if n > LEAST else []
    out, last = [], 0
    for at in marks:
        while at - last > LARGEST:
            last += LARGEST
            out.append(last)
        if at - last >= LEAST:
            out.append(at)
            last = at
    while n - last > LARGEST:
        last += LARGEST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunk_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, idx, start, size, d1, d2): every chunk with its digest as two longs; copy is a hash of the whole text.

    A null or empty text has no chunks; a null id stands as the smallest long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                counts, index, ends, digests, copies = [], [], [], [], []
                for raw in part.column(1).to_pylist():
                    stops = cuts(raw or b"")
                    counts.append(len(stops))
                    index.append(np.arange(len(stops), dtype=np.int32))
                    ends += stops
                    copies.append(xxhash.xxh3_64_intdigest(raw or b""))
                    a = 0
                    for b in stops:
                        digests.append(xxhash.xxh3_128_digest(raw[a:b]))
                        a = b
                idx, end = np.concatenate(index), np.array(ends, np.int32)
                start = np.where(idx == 0, 0, np.roll(end, 1)).astype(np.int32)
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
                copy = np.repeat(np.array(copies, np.uint64).view(np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, copy, idx, start, (end - start).astype(np.int32), pair[:, 0].copy(), pair[:, 1].copy())], ["doc", "copy", "idx", "start", "size", "d1", "d2"])

    picked = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text_col).cast("binary").alias("raw"))
    return picked.mapInArrow(run, "doc long, copy long, idx int, start int, size int, d1 long, d2 long")


def repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks whose digest stands in two or more documents, with first_doc, the smallest id that holds it. A document is an id with a text."""
    chunks = chunk_table(df, id_col, text_col)
    sums = chunks.groupBy("d1", "d2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.min("copy").alias("c1"), F.max("copy").alias("c2"), F.count(F.lit(1)).alias("n"))
    shared = written(sums.filter("first_doc < last_doc or c1 < c2").select("d1", "d2", "first_doc", "n"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return split_join(chunks, shared, ["d1", "d2"], "n", total)


def _runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks that other documents hold too (doc, copy, idx, start, size, first_doc) with run, which neighbours share."""
    held = repeated_chunks(df, id_col, text_col).groupBy("doc", "copy", "idx").agg(F.first("start").alias("start"), F.first("size").alias("size"), F.first("first_doc").alias("first_doc"))
    return held.withColumn("run", F.col("idx") - F.row_number().over(Window.partitionBy("doc", "copy").orderBy("idx")))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(id, start, end, n_chunks, first_doc_id): runs of chunks, min_run bytes or longer, that other documents hold too.

    start and end are byte positions in the UTF-8 text, end exclusive; first_doc_id is the smallest
    id that holds one of the run's chunks. Repeats within one document alone don't count. A document is
    an id with a text: repeated rows (same id and text) give their passages once, and an id with another
    text is another document. Null and empty texts give none; a null id with a text counts as a document
    and is reported with id null (first_doc_id null where such a row holds the chunk). Ids are longs. Other columns are not
    read; an empty table gives an empty result.
    """
    real = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    spans = _runs(df, id_col, text_col).groupBy("doc", "copy", "run").agg(F.min("start").cast("long").alias("start"), F.sum("size").alias("length"), F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc").alias("first_doc"))
    return spans.filter(F.col("length") >= min_run).select(real("doc").alias(id_col), "start", (F.col("start") + F.col("length")).alias("end"), "n_chunks", real("first_doc").alias("first_doc_id"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """df without the repeated passages' chunks in all documents but the first that holds each chunk, so that every chunk stays once.

    A passage is a run of min_run bytes or more; which document is first is told chunk by chunk, as a run may come from
    several. Ids must be unique and not null. Every row and column stays; a text may become empty.
    """
    runs = _runs(df, id_col, text_col)
    long = F.sum("size").over(Window.partitionBy("doc", "copy", "run")) >= min_run
    gone = runs.withColumn("long", long).filter(F.col("long") & (F.col("doc") != F.col("first_doc")))
    lists = gone.groupBy(F.col("doc").alias("__cdc_id")).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("__cdc_spans"))
    joined = df.join(lists, F.col(id_col) == F.col("__cdc_id"), "left").drop("__cdc_id")
    at, schema = df.columns.index(text_col), df.schema

    def clean(text: str | None, spans: list[dict] | None) -> str | None:
        if not spans:
            return text
        raw, out, done = text.encode(), [], 0
        for s in spans:
            out.append(raw[done : s["start"]])
            done = s["end"]
        return b"".join([*out, raw[done:]]).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            cols[at] = pa.array([clean(t, s) for t, s in zip(cols[at].to_pylist(), batch.columns[-1].to_pylist(), strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, schema)
