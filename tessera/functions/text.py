"""Text functions as column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import BODY, CHARS_A_WORD, DIACRITICS, ENGLISH, PORTUGUESE, SOURCE_MARK, TARGET_SHARES


def _decomposed() -> tuple[str, str]:
    """Lower-case letters of the Latin, Greek and Cyrillic blocks that are a letter with marks, and those letters."""
    pairs = {}
    for code in (*range(0xC0, 0x600), *range(0x1E00, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _decomposed()


def unaccented(c: Column) -> Column:
    """Letters without the marks that canonical decomposition takes off, loose marks too."""
    return F.translate(F.regexp_replace(c, "[\u0300-\u036f]", ""), ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return unaccented(F.lower(c))


def collapsed(c: Column) -> Column:
    """Runs of blanks, no-break ones too, as one blank."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s\x{a0}\x{202f}\x{2003}\x{2009}]+", " "), "^ | $", "")


#: Characters of a slug.
SLUG = 80


def slug_cut(s: Column, most: int | Column) -> Column:
    """A slug of ``most`` characters at most, cut at its last hyphen if that is past the middle."""
    most = F.lit(most) if isinstance(most, int) else most
    head = F.substring(s, F.lit(1), most)
    at = F.length(head) - F.locate("-", F.reverse(head))  # characters before the last hyphen
    cut = F.when(F.contains(head, F.lit("-")) & (at > most * 0.5), F.left(head, at)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(cut, "-+$", ""))


def slugify(c: Column, most: int = SLUG) -> Column:
    """Letters a-z, digits and single hyphens, ``most`` characters at most."""
    s = F.regexp_replace(F.regexp_replace(fold(F.regexp_replace(c, "[\"'’‘“”]", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return slug_cut(s, most)


def upper_each(text: Column) -> Column:
    """text in capitals letter by letter, so that its length stays: ß becomes ẞ, and letters whose capital is several letters take their title form or stay."""
    one = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).when(F.length(F.initcap(c)) == 1, F.initcap(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def with_suffix(slug: Column, digest: Column, size: int = 6, most: int = SLUG) -> Column:
    """The slug with the digest's beginning, both within ``most`` characters; `noticia-…` where the slug is null or empty."""
    suffix = F.substring(digest, 1, size)
    base = slug_cut(slug, F.lit(most) - F.length(suffix) - 1)
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("noticia")), F.lit("-"), suffix)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def stop_counts(c: Column) -> Column:
    """struct(en, pt): English and Portuguese function words, counted in one pass over the words."""
    zero = F.struct(F.lit(0).alias("en"), F.lit(0).alias("pt"))
    add = lambda acc, w: F.struct((acc["en"] + w.isin(list(ENGLISH)).cast("int")).alias("en"), (acc["pt"] + w.isin(list(PORTUGUESE)).cast("int")).alias("pt"))
    return F.aggregate(words(c), zero, add)


def english_share(counts: Column) -> Column:
    """The English ones' share: 1 if there are none."""
    return F.when(counts["en"] + counts["pt"] == 0, F.lit(1.0)).otherwise(counts["en"] / (counts["en"] + counts["pt"]))


def diacritic_density(c: Column) -> Column:
    return F.regexp_count(c, F.lit(DIACRITICS)) / F.greatest(F.length(c), F.lit(1))


def paragraphs(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\n{2,}"), lambda p: F.trim(p) != ""))


def reading_minutes(c: Column, pace: int = 200) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(words(c)) / pace)).cast("long")


def shorten(c: Column, most: int) -> Column:
    """Cut to most characters, at the last blank where it is past 60 %, without trailing signs, and an ellipsis."""
    head = F.substring(F.trim(c), 1, most)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when(F.contains(head, F.lit(" ")) & (last > most * 0.6), F.left(head, last)).otherwise(head)
    return F.when(F.length(F.trim(c)) <= most, F.trim(c)).otherwise(F.concat(F.regexp_replace(cut, r"[\s.,;:—-]+$", ""), F.lit("…")))


def tags(c: Column, most: int = 6) -> Column:
    """Trimmed, lower-cased, distinct in order, two letters or longer, at most six."""
    clean = F.transform(c, lambda t: F.substring(F.regexp_replace(F.lower(F.trim(t)), "[#\"']", ""), 1, 32))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: F.length(t) >= 2)), 1, most)


def xml_escape(c: Column) -> Column:
    """Without control characters, the five signs as entities."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cdata_safe(c: Column) -> Column:
    """No end of a CDATA section."""
    return F.replace(c, F.lit("]]>"), F.lit("]]&gt;"))


def brief(c: Column, most: int) -> Column:
    """Blanks collapsed; longer texts are cut to most - 1 characters, at the last blank where it is past 60 %, with an ellipsis."""
    clean = collapsed(c)
    head = F.substring(clean, 1, most - 1)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when(F.contains(head, F.lit(" ")) & (last > most * 0.6), F.left(head, last)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def without_brand(title: Column, brand: str) -> Column:
    """Without a brand at the end that ' | ', ' - ' or ' – ' divides from the title."""
    out = F.trim(title)
    for sep in (" – ", " - ", " | "):
        out = F.when(title.endswith(sep + brand), F.trim(F.left(title, F.length(title) - len(sep + brand)))).otherwise(out)
    return out


def is_blank(c: Column) -> Column:
    """Empty, or dashes, dots and blanks alone."""
    return c.rlike(r"^[-–—.\s]*$")


def summary(lines: Column, most: int = 160) -> Column:
    """Lines of a cell in one, cut."""
    return F.substring(F.array_join(lines, " | "), 1, most)


def source_block(name: Column, url: Column) -> Column:
    return F.concat(F.lit(f"{SOURCE_MARK} ["), name, F.lit("]("), url, F.lit(")"))


def has_source_block(body: Column) -> Column:
    return F.contains(body, F.lit(SOURCE_MARK))


def final_body(body: Column, name: Column, url: Column) -> Column:
    """The trimmed body with its attribution."""
    return F.concat(stripped(body), F.lit("\n\n"), source_block(name, url), F.lit("\n"))


def stripped(c: Column) -> Column:
    """Without blanks and line ends on both sides."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_attribution(body: Column) -> Column:
    """Without the paragraphs in which a model names sources itself."""
    kept = F.filter(F.split(body, r"\n{2,}"), lambda p: ~p.rlike(r"(?i)^\s*>?\s*\**\s*fontes?\s*:"))
    return stripped(F.array_join(kept, "\n\n"))


def target_chars(length: Column) -> Column:
    """struct(min, max): characters that an adaptation of a text of that length should have."""
    low, high = (F.floor(length * share + 0.5) for share in TARGET_SHARES)
    least = F.least(F.greatest(low, F.lit(BODY[0])), F.lit(BODY[1] - 200))
    return F.struct(least.cast("long").alias("min"), F.least(F.greatest(high, least + 150), F.lit(BODY[1])).cast("long").alias("max"))


def target_words(chars: Column) -> Column:
    """Characters as words."""
    return F.floor(chars / CHARS_A_WORD + 0.5).cast("long")


def blocks(markdown: Column) -> Column:
    """array of struct(kind, text): headings, quotes, lists and paragraphs, without their marks; a list's items keep a line each."""
    parts = F.filter(F.transform(F.split(stripped(markdown), r"\n{2,}"), stripped), lambda b: b != "")

    def typed(b: Column) -> Column:
        kind = F.when(b.startswith("## "), "h2").when(b.startswith("> "), "quote").when(b.startswith("- "), "list").otherwise("p")
        text = F.when(b.startswith("## "), F.substr(b, F.lit(4))).when(b.startswith("> "), F.substr(b, F.lit(3))).when(b.startswith("- "), F.regexp_replace(b, r"(?m)^-\s+", "")).otherwise(b)
        return F.struct(kind.alias("kind"), text.alias("text"))

    return F.transform(parts, typed)


def inline_tokens(line: Column) -> Column:
    """array of struct(kind, text, url): links (text alone where the address isn't http or https), bold, italic and the text between."""
    found = F.regexp_extract_all(line, F.lit(r"(\[[^\]\n]+\]\([^)\s]+\)|\*\*[^*]+\*\*|\*[^*]+\*|(?:(?!\[[^\]\n]+\]\([^)\s]+\)|\*\*[^*]+\*\*|\*[^*]+\*)[\s\S])+)"), F.lit(1))

    def typed(t: Column) -> Column:
        url = F.regexp_extract(t, r"^\[[^\]\n]+\]\(([^)\s]+)\)$", 1)
        label, safe = F.regexp_extract(t, r"^\[([^\]\n]+)\]\([^)\s]+\)$", 1), url.rlike("(?i)^https?://[^/?#]")
        kind = F.when((url != "") & safe, "link").when(url != "", "text").when(t.rlike(r"^\*\*[^*]+\*\*$"), "bold").when(t.rlike(r"^\*[^*]+\*$"), "italic").otherwise("text")
        text = F.when(url != "", label).when(kind == "bold", F.substring(t, 3, 1 << 30)).when(kind == "italic", F.substring(t, 2, 1 << 30)).otherwise(t)
        text = F.when(kind == "bold", F.left(text, F.length(text) - 2)).when(kind == "italic", F.left(text, F.length(text) - 1)).otherwise(text)
        return F.struct(kind.alias("kind"), text.alias("text"), F.when((url != "") & safe, url).alias("url"))

    return F.transform(found, typed)


def email(c: Column) -> Column:
    """A trimmed address in lower case; null where it isn't one or is over 254 characters."""
    clean = F.lower(F.trim(c))
    ok = clean.rlike(r"^(?!\.)(?!.*\.\.)[a-z0-9_'+.-]*[a-z0-9_+-]@(?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,}$") & (F.length(clean) <= 254)
    return F.when(ok, clean)
