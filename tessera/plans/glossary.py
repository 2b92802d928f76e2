"""The glossary as a table: blocks for a prompt by kind, and its terms in whole texts, the longest first.

A glossary has columns term, translation, kind, note (null for none) and place, its order; it is a parameter, as editors own it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of blocks, and those that every prompt has.
KINDS = ("instituicao", "titulo", "processo", "rito1962", "santo", "documento", "doutrina")
CORE = ("instituicao", "titulo", "processo", "rito1962")
#: Entries that a glossary has at most, so that it can be sent to every task.
MOST = 100_000
WORD = r"([\p{L}\p{N}]+)"
#: Words that a task looks at together, a longer text alone.
PART_WORDS = 1 << 20


def checked(glossary: DataFrame) -> DataFrame:
    """The glossary, counted: more than MOST entries are no glossary."""
    n = glossary.count()
    if n > MOST:
        raise ValueError(f"{n} entries; a glossary has {MOST} at most")
    return glossary


def blocks(glossary: DataFrame, kinds: tuple[str, ...] = CORE, order: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, place, n, block): the block of each of ``kinds`` that has entries: its heading and a line an entry in the glossary's order. Kinds stand in ``order``."""
    line = F.concat(F.lit("  "), F.col("term"), F.lit(" = "), F.col("translation"), F.coalesce(F.concat(F.lit("  ("), F.col("note"), F.lit(")")), F.lit("")))
    rows = glossary.filter(F.col("kind").isin(*kinds)).select("kind", F.col("place").alias("__at"), line.alias("__line"))
    told = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.expr(r"listagg(__line, '\n') within group (order by __at)").alias("lines"))
    places = F.create_map(*(x for k, name in enumerate(order) for x in (F.lit(name), F.lit(k))))
    return told.select("kind", F.get(F.array(places[F.col("kind")]), F.lit(0)).alias("place"), "n", F.concat(F.lit("["), F.col("kind"), F.lit("]\n"), F.col("lines")).alias("block"))


def prompt(glossary: DataFrame, kinds: tuple[str, ...] = CORE) -> DataFrame:
    """One row: all blocks as one text."""
    return blocks(glossary, kinds).agg(F.expr(r"listagg(block, '\n') within group (order by place)").alias("text"))


def looked_up(terms: DataFrame, glossary: DataFrame, term: str = "term") -> DataFrame:
    """terms with translation and kind of the entry with the same words in any letter case; of several entries the last one counts."""
    known = glossary.groupBy(F.lower(F.trim("term")).alias("__term")).agg(F.max_by(F.struct("translation", "kind"), "place").alias("__e"))
    return terms.join(F.broadcast(checked(known)), F.lower(F.trim(term)) == F.col("__term"), "left").select(*terms.columns, "__e.translation", "__e.kind")


def met(texts: DataFrame, glossary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, n_words, term): the terms in each text, as whole words in any letter case, from left to right and the longest at each place; a word is part of one term at most. Positions count words from 0.

    Texts are split by Spark; each task follows its texts' words through the tree of the terms' words, all words of a batch at
    once and in as many steps as the longest term has words, so that neither the terms nor a text's length make a word dearer.
    Keys may repeat. Null texts have no terms.
    """
    entries = glossary.select(F.col("term"), F.regexp_extract_all(F.lower("term"), F.lit(WORD), F.lit(1)).alias("words"), "place").filter(F.size("words") > 0)
    entries = checked(entries.groupBy("words").agg(F.min_by("term", "place").alias("term")))
    tree = Tree([(r["words"], r["term"]) for r in entries.collect()])  # MOST at most, as a glossary has

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            ends = np.cumsum(sizes)
            a = 0
            while a < len(batch):  # some texts at a time, so that memory follows the longest of them and not the batch
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + PART_WORDS, "right")))
                text, at, n, number = tree.found(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(text)), pa.array(at), pa.array(n), tree.terms.take(pa.array(number))], ["key", "position", "n_words", "term"])
                a = b

    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    split = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("words"))
    return split.mapInArrow(scan, f"key {texts.schema[key].dataType.simpleString()}, position long, n_words long, term string").withColumnRenamed("key", key)


class Tree:
    """Terms by their words: a node for each beginning of a term, its steps sorted by (node, word)."""

    def __init__(self, entries: list[tuple[list[str], str]]):
        word, steps, nodes = {}, {}, 1
        self.terms, ends = pa.array([t for _, t in entries], pa.string()), {}
        for k, (words, _) in enumerate(entries):
            node = 0
            for w in words:
                step = (node, word.setdefault(w, len(word)))
                if step not in steps:
                    steps[step], nodes = nodes, nodes + 1
                node = steps[step]
            ends[node] = k
        self.words = pa.array(list(word), pa.string())
        keys = np.array([node * len(word) + w for node, w in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.term = np.full(nodes, -1, np.int64)
        self.term[list(ends)] = list(ends.values())

    def found(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(text, position, words, term) of the terms that are taken, by number."""
        sizes = pc.list_value_length(texts).to_numpy()
        code = pc.fill_null(pc.index_in(texts.flatten(), value_set=self.words), -1).to_numpy().astype(np.int64)
        end = np.repeat(np.cumsum(sizes), sizes)
        n, term = np.zeros(len(code), np.int64), np.full(len(code), -1, np.int64)
        at, node, deep = np.flatnonzero(code >= 0), 0, 0
        while len(at):  # at: where a beginning of a term of ``deep`` words stands
            step = node * len(self.words) + code[at + deep]
            place = np.minimum(np.searchsorted(self.keys, step), len(self.keys) - 1)
            met = self.keys[place] == step
            at, node, deep = at[met], self.next[place[met]], deep + 1
            full = self.term[node] >= 0
            n[at[full]], term[at[full]] = deep, self.term[node[full]]
            on = at + deep < end[at]
            at, node = at[on], node[on]
            on = code[at + deep] >= 0
            at, node = at[on], node[on]
        met, last, taken = np.flatnonzero(n), 0, []
        for k, size in zip(met.tolist(), n[met].tolist(), strict=True):
            if k >= last:  # a text's terms end within it
                taken.append(k)
                last = k + size
        at = np.array(taken, np.int64)
        ends = np.cumsum(sizes)
        owner = np.searchsorted(ends, at, "right")
        return owner, at - (ends - sizes)[owner], n[at], term[at]
