"""Categories of articles and pages: path, the feed's own categories, title lexicon, then the default."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import CATEGORIES, DEFAULT_CATEGORY, FEED_CATEGORY, LEXICON, PATH_CATEGORY
from ..functions.text import fold
from ..functions.url import path_segments


def path_category(url: Column) -> Column:
    """Category of the first known one of the path's first two segments, else null."""
    names = F.create_map(*(F.lit(x) for pair in PATH_CATEGORY.items() for x in pair))
    return F.get(F.filter(F.transform(path_segments(url), lambda s: names[fold(s)]), lambda c: c.isNotNull()), F.lit(0))


def lexicon_category(title: Column) -> Column:
    """The category with most terms in the title, the earlier one on a tie; null without any."""
    low = fold(title)
    scores = F.array(*(F.struct(sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(slug).alias("slug")) for k, (slug, terms) in enumerate(LEXICON)))
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["slug"])


def feed_category(categories: Column) -> Column:
    """Category of the first of a feed's categories that is a known, specific one; null without any."""
    names = F.create_map(*(F.lit(x) for pair in FEED_CATEGORY.items() for x in pair))
    return F.get(F.filter(F.transform(categories, lambda c: names[F.trim(fold(c))]), lambda c: c.isNotNull()), F.lit(0))


def category(url: Column, title: Column, categories: Column | None = None) -> Column:
    """Path, feed's categories, title's terms, default: the first that decides."""
    return F.coalesce(path_category(url), *([] if categories is None else [feed_category(categories)]), lexicon_category(title), F.lit(DEFAULT_CATEGORY))


def label(slug: Column) -> Column:
    """A category's label; an unknown one has the default's."""
    names = F.create_map(*(F.lit(x) for slug_, text, *_ in CATEGORIES for x in (slug_, text)))
    return F.coalesce(names[slug], names[F.lit(DEFAULT_CATEGORY)])


def refined(current: Column, suggested: Column) -> Column:
    """The suggestion where the category is still the default and the suggestion is a category, else the current one."""
    return F.when((current == DEFAULT_CATEGORY) & suggested.isin([c[0] for c in CATEGORIES]), suggested).otherwise(current)


def resolved(name: Column, aliases: dict[str, str], default: str) -> Column:
    """The full name behind an alias; other names pass, blank ones are the default."""
    clean = F.nullif(F.trim(name), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(known[clean], clean, F.lit(default))
