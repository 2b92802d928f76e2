"""HTML functions: small event handlers per page inside Arrow batches; pages never leave their partition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

# Tags whose text nobody reads, tags that end a line, tags without an end.
SKIPPED = frozenset("script style noscript iframe svg template".split())
BLOCKS = frozenset("p div br hr li ul ol tr td th table h1 h2 h3 h4 h5 h6 blockquote section article header footer figure figcaption pre".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Classes of an article's container, tags that aren't its body, least characters of a paragraph, paragraphs that settle it.
CONTAINERS = frozenset("entry-content post-content article-content wp-block-post-content td-post-content".split())
ASIDES = frozenset("script style noscript figcaption aside nav form button".split())
PARAGRAPH, ENOUGH = 80, 3
# Names of a page's fields, by preference; the head's length where it has no end.
META = {
    "og_title": ("og:title", "twitter:title"), "og_description": ("og:description", "twitter:description", "description"), "og_image": ("og:image", "og:image:secure_url", "twitter:image"),
    "og_author": ("article:author", "author"), "og_published": ("article:published_time",),
}
HEAD = 200_000
#: Pages that are read together.
PAGES = 256


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """Readable text: lines at block tags, blanks collapsed, one empty line at most; null stays null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t\u00a0]+", " ", "".join(parser.parts))
    return re.sub(r" *\n *", "\n", re.sub(r" *\n *(?:\n *)+", "\n\n", text)).strip()


class _Meta(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            held = dict(attrs)
            name, value = (held.get("property") or held.get("name") or "").lower(), (held.get("content") or "").strip()
            if name and value:
                self.found.setdefault(name, value)


def open_graph(html: str | None) -> tuple[str | None, ...]:
    """Title, description, image, author and publication of a page's head; a name's first value counts, the preferred name wins."""
    head = re.split(r"(?i)</head\s*>", html or "", maxsplit=1)
    parser = _Meta()
    parser.feed(head[0] if len(head) > 1 else head[0][:HEAD])
    return tuple(next((parser.found[n] for n in names if n in parser.found), None) for names in META.values())


class _Body(HTMLParser):
    """Paragraphs of the page, or of its container alone."""

    def __init__(self, within: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.within, self.open, self.inside, self.aside, self.text, self.paragraphs = within, [], None, None, None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if tag == "p" and self.text is not None:
            self.handle_endtag("p")
        self.open.append(tag)
        depth = len(self.open)
        if self.aside is None and tag in ASIDES:
            self.aside = depth
        if self.aside is not None:
            return
        if self.within and self.inside is None and CONTAINERS & set((dict(attrs).get("class") or "").split()):
            self.inside = depth
        elif tag == "p" and (not self.within or self.inside is not None):
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            depth, last = len(self.open), self.open.pop()
            if last == "p" and self.text is not None:
                clean = " ".join("".join(self.text).split())
                self.text = None
                if len(clean) >= PARAGRAPH:
                    self.paragraphs.append(clean)
            if self.aside == depth:
                self.aside = None
            if self.inside == depth:
                self.inside = None
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.text is not None and self.aside is None:
            self.text.append(data)


def article_body(html: str | None) -> tuple[str | None, int, bool | None]:
    """(text, paragraphs, whether a known container holds them): the container's if it has three or more, else all of the page's if they are, else what there is."""
    found = []
    for within in (True, False):
        parser = _Body(within)
        parser.feed(html or "")
        parser.close()
        while parser.open:
            parser.handle_endtag(parser.open[-1])
        if parser.paragraphs:
            found.append(("\n\n".join(parser.paragraphs), len(parser.paragraphs), within))
    best = next((x for x in found if x[1] >= ENOUGH), found[0] if found else None)
    return best or (None, 0, None)


class _Tables(HTMLParser):
    """Rows of tables as cells of lines, and headings."""

    BREAKS = frozenset(("br", "p", "div", "li", "tr"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.headings, self.row, self.cell, self.text, self.depth, self.heading = [], [], None, None, "", 0, 0

    def _line(self) -> None:
        line, self.text = " ".join(self.text.split()), ""
        if line and self.cell is not None:
            self.cell.append(line)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            if not self.depth:
                self.cell, self.text = [], ""
            self.depth += 1
        elif self.depth and tag in self.BREAKS:
            self._line()
        elif re.fullmatch("h[1-4]", tag):
            self.heading += 1
            if self.heading == 1 and not self.depth:
                self.text = ""

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.depth = max(0, self.depth - 1)
            if not self.depth:
                self._line()
                if self.row is not None and self.cell is not None:
                    self.row.append(self.cell)
                self.cell = None
        elif tag == "tr":
            if self.row:
                self.rows.append(self.row)
            self.row = None
        elif self.depth and tag in self.BREAKS:
            self._line()
        elif re.fullmatch("h[1-4]", tag):
            self.heading = max(0, self.heading - 1)
            if not self.heading and not self.depth:
                line, self.text = " ".join(self.text.split()), ""
                if line:
                    self.headings.append(line)

    def handle_data(self, data: str) -> None:
        if self.depth or self.heading:
            self.text += data


def tables(html: str | None) -> tuple[list[list[list[str]]], list[str]]:
    """(rows of four cells, each an array of lines; headings h1 to h4)."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [r for r in parser.rows if len(r) == 4], parser.headings


def clean_text(c: Column) -> Column:
    """Text of what may be HTML or not; null where nothing is left."""
    read = F.pandas_udf(lambda s: s.map(html_text, na_action="ignore"), StringType())
    tagged = F.when(c.rlike("(?i)<[a-z!/]"), c)  # Spark runs a UDF on every row, so that others go in as null
    return F.nullif(F.when(tagged.isNotNull(), read(tagged)).otherwise(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def _per_page(pages: DataFrame, id_col: str, html_col: str, read: object, fields: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., fields) of each page, in Arrow batches, PAGES at a time."""
    made, names = StructType.fromDDL(fields), [id_col, *keep]
    held = [StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(names)]
    types = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES):
                part = batch.slice(k, PAGES)
                rows = [read(x) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], [*(f.name for f in held), *made.names])

    picked = pages.select(*(pages[c].alias(f"k{i}") for i, c in enumerate(names)), pages[html_col].alias("html"))
    out = picked.mapInArrow(run, StructType([*held, *made.fields]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), *made.names)


def read_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, body, n_paragraphs, by_container, og_title, og_description, og_image, og_author, og_published); null or empty HTML gives nulls and no paragraphs."""

    def read(html: str | None) -> tuple:
        return (html_text(html) or None, *article_body(html), *open_graph(html))

    return _per_page(pages, id_col, html_col, read, "text string, body string, n_paragraphs long, by_container boolean, og_title string, og_description string, og_image string, og_author string, og_published string")


def read_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., rows array<array<array<string>>>, headings array<string>) of each page's tables."""
    return _per_page(pages, id_col, html_col, tables, "rows array<array<array<string>>>, headings array<string>", keep)
