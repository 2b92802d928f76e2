"""License scans by a positional rare-token index, in DataFrame functions only.

The index is a table of postings: for each rarer word of the templates (short licence texts) the templates and
positions where it stands, with the word's IDF over all scanned documents as weight. One pass over the
texts keeps the places of index words and of the templates' mandatory phrases, a few numbers a document. Index words meet their postings
in a join; postings of one document and template that agree on the relative position add up, and a
template whose weight is mostly met counts where its mandatory phrase stands at that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, written

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values: (label, words of the template, mandatory phrase in it).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("cc", "licensed under cc by nc 4 0", "cc by"),
    ("cc", "licensed under cc by", "cc by"),
    ("cc", "licensed under a creative commons attribution", "creative commons"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related rights to the public domain", "dedicated all copyright and related"),
    ("epl", "eclipse public license", "eclipse public license"),
)
#: Common words that the index leaves out.
STOP = frozenset("a all and any are as at by can do file for form forms free in is it may not of or the this to under use version with without work you 0 2 3 4 an be from has into its no nor on shall unless will 1".split())
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words that every row holds weigh next to nothing, not nothing: a template of such words alone can still be met.
MIN_SCORE, LEAST_WEIGHT = 0.6, 1e-9


def postings(templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, position) of the templates' words but the common ones."""
    return [(w, t, i) for t, (_, text, _) in enumerate(templates) for i, w in enumerate(text.split()) if w not in STOP]


def normalised(text: Column) -> Column:
    """Words with single spaces between them, A-Z lower-cased."""
    return F.translate(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")), UPPER, UPPER.lower())


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand, as an array of starts."""
    parts = phrase.split()
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == parts[0]) & (F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase))
    return F.when(F.array_contains(words, parts[0]), starts).otherwise(F.array().cast("array<int>"))


def looked_up(df: DataFrame, id_col: str, text_col: str, templates=TEMPLATES) -> DataFrame:
    """A written table (row, id, n_words, base, hits, starts): of each text the places of base phrases by label, of index words, and of the templates' mandatory phrases."""
    index, phrases = sorted({w for w, _, _ in postings(templates)}), sorted({p for _, _, p in templates})
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    words = F.col("words")
    rows = rows.select("id", F.split("norm", " ", -1).alias("words"), (F.col("norm") == "").alias("none"))
    at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(index), i)))
    rows = rows.select("id", "words", F.when(F.col("none"), F.lit(0)).otherwise(F.size("words")).cast("long").alias("n_words"), at.alias("at"))
    # A mandatory phrase or a base one holds an index word, so texts without any need no look.
    some = F.size("at") > 0
    found = lambda names: F.when(some, F.flatten(F.array(*(_keyed(k, _places(words, p)) for k, p in enumerate(names))))).otherwise(F.array().cast("array<struct<key:int,i:int>>"))
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "id", "n_words", found([p for p, _ in PHRASES]).alias("base"), F.transform("at", lambda i: F.struct(i.alias("i"), F.get(words, i).alias("word"))).alias("hits"), found(phrases).alias("starts"),
        ),
        "lookups",
    )


def _keyed(key: int, places: Column) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(key).alias("key"), i.alias("i")))


def _table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small table from literals, without Python workers."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))).alias("r")).select("r.*")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = MIN_SCORE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row, over whole texts.

    score is the largest share of a template's rare-word weight that stands at matching relative
    positions around its mandatory phrase (1.0 where a base phrase stands, 0.0 without licence words). A null or empty text has
    no words, empty labels, null places and score 0. Repeated rows stay; other columns are not read;
    an empty table gives an empty result.
    """
    spark, rows = df.sparkSession, looked_up(df, id_col, text_col, templates)
    n = rows.count()
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.i")
    # Weights: ln((N + 1) / (df + 1)), LEAST_WEIGHT at least; the table has a row a posting, as many as the templates have words.
    frequency = hits.select("row", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    index = _table(spark, postings(templates), ("word", "template", "position")).join(frequency, "word", "left")
    index = index.select("word", "template", "position", F.greatest(F.log((F.lit(float(n)) + 1) / (F.coalesce("df", F.lit(0)) + 1)), F.lit(LEAST_WEIGHT)).alias("weight"))
    full = index.groupBy("template").agg(F.sum("weight").alias("full"))

    votes = hits.join(F.broadcast(index), "word").groupBy("row", "template", (F.col("i") - F.col("position")).alias("off")).agg(F.sum("weight").alias("met"))
    phrases = sorted({p for _, _, p in templates})
    leads = [(t, phrases.index(p), next(i for i in range(len(text.split())) if " ".join(text.split()[i:]).startswith(p)), label) for t, (label, text, p) in enumerate(templates)]
    lead = _table(spark, leads, ("template", "key", "lead", "label")).join(full, "template")
    stands = rows.select("row", F.explode("starts").alias("s")).select("row", "s.key", "s.i").join(F.broadcast(lead), "key").select("row", "template", (F.col("i") - F.col("lead")).alias("off"), "label", "full")
    shares = stands.join(votes, ["row", "template", "off"]).select("row", "label", F.round(F.col("met") / F.col("full"), 12).alias("share"))
    found = shares.groupBy("row").agg(F.max("share").alias("share"), F.collect_set(F.when(F.col("share") >= least - 1e-9, F.col("label"))).alias("more"))

    names = F.create_map(*(F.lit(x) for k, (_, label) in enumerate(PHRASES) for x in (k, label)))
    base, places = F.transform("base", lambda x: names[x["key"]]), F.transform("base", lambda x: x["i"])
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), text_of(base).alias("base_labels"),
        text_of(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
