"""Sources by name, with a flag and an optional step of enrichment; a new source is one more entry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

#: Session settings: <PREFIX>.<name>.enabled.
PREFIX = "tessera.source"


@dataclass(frozen=True)
class Source:
    """collect gives a source's rows from the feed items and now; enrich the articles from their pages. on: without a setting."""

    name: str
    title: str
    collect: Callable[[DataFrame, Column], DataFrame]
    enrich: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    on: bool = True


class Registry:
    def __init__(self, sources: tuple[Source, ...]):
        names = [s.name for s in sources]
        if len(set(names)) < len(names) or not all(n and n.isidentifier() for n in names):
            raise ValueError(f"names must be different identifiers: {names}")
        self.sources = sources

    def enabled(self, spark: SparkSession) -> list[Source]:
        """The sources that are on; a setting other than true and false is an error that names it."""
        out, bad = [], []
        for source in self.sources:
            said = spark.conf.get(f"{PREFIX}.{source.name}.enabled", None)
            if said is not None and said.lower() not in ("true", "false"):
                bad.append(f"{PREFIX}.{source.name}.enabled = {said}")
            elif source.on if said is None else said.lower() == "true":
                out.append(source)
        if bad:
            raise ValueError(f"settings must be true or false: {', '.join(bad)}")
        return out

    def collect(self, items: DataFrame, now: Column) -> DataFrame:
        """The rows of all sources that are on, in one table."""
        batches = [s.collect(items, now) for s in self.enabled(items.sparkSession)]
        if not batches:
            raise ValueError("no source is on")
        return reduce(DataFrame.unionByName, batches)

    def enrich(self, articles: DataFrame, pages: DataFrame) -> DataFrame:
        """articles after the enrichment steps of the sources that are on, one after another."""
        return reduce(lambda rows, s: s.enrich(rows, pages) if s.enrich else rows, self.enabled(articles.sparkSession), articles)
