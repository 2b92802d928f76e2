"""Secret scans: fixed patterns plus strings that a dictionary-primed zstandard can't shorten.

A candidate is a run of 16 or more key characters, or of 12 or more after a name and '='. It is
measured where its context is sensitive: a sensitive word stands before it in its line or in the line
with text above, or in the name that it is assigned to. The values of the assign pattern are measured as well. Novelty
is the number of bytes that a candidate adds to the compressed form of its surrounding code (the
``AROUND`` characters on each side), with a dictionary of identifiers loaded; per character that nears
the entropy of random keys, while words that the surroundings or the dictionary hold cost almost nothing.

The dictionary has a fixed list of names and the corpus's own identifiers: words of letters, joined by
'_', '-' or '.', of one letter case, by the number of distinct lines that hold them, the most frequent
``DICTIONARY_BYTES`` of them. Random keys have no such form, so that copies of a key don't make it known.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, thrifty

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
#: Whole runs start where no run goes on, so a lookbehind spares the search inside words.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: After '@' stands an address's host.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=@-])[A-Za-z0-9+/_.=-]{16,}")
#: What '=' cuts a run into; its padding stays with a value. Values after a name count from as many characters as assigned ones.
PIECE, VALUE = re.compile(r"[^=]+=*"), 12
#: Names of several words in one letter case.
NAME = re.compile(r"[-.]*(?:[A-Z][A-Z0-9]*(?:[_.-]+[A-Z0-9]+)+|[a-z][a-z0-9]*(?:[_.-]+[a-z0-9]+)+)=+")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: In lower case, '_' and '-' read as blanks.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api key", "credential", "private key", "privatekey", "bearer", "authorization")
SENSITIVE_WORD = re.compile("|".join(map(re.escape, sorted(SENSITIVE, key=len, reverse=True))))
#: Names that code and configuration around keys are full of.
IDENTIFIERS = (
    "import from return const static public private class function def self this null None true false string value values config configuration settings environment "
    "client server request response header headers authorization bearer content-type application/json username password passwd secret token access_token refresh_token "
    "api_key apikey api-key client_id client_secret private_key public_key credentials connection database localhost endpoint version default example.com https://www. "
    "http:// placeholder changeme your_password_here your_token_here process.env os.environ /usr/local/share/ /usr/lib/ /home/ /etc/ /var/log/ /opt/ getenv export parameter argument description identifier abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 ffffffffffffffff xxxxxxxxxxxxxxxx 12345678901234567890 deadbeef"
)
#: Characters on each side that the compressor sees, least bytes a character of a reported candidate, bytes of the learnt dictionary.
AROUND, MIN_NOVELTY, DICTIONARY_BYTES = 512, 0.57, 32_768
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9+/_.=-])(?:[a-z]{3,}(?:[_.-][a-z]{2,})*|[A-Z]{3,}(?:[_.-][A-Z]{2,})*|[A-Z][a-z]{2,})(?=[\"'(){}\[\]<>,;:=\s]|$)")
LINE = re.compile(r"[^\n]+")


def learned_identifiers(df: DataFrame, text_col: str = "text", n_bytes: int = DICTIONARY_BYTES) -> str:
    """The corpus's most frequent identifiers of 4 to 40 characters near sensitive words, rarest first, at most n_bytes in all. Counts cover all lines with a sensitive word; equal counts go by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                low = folded(text or "")
                at, done = [m.start() for m in SENSITIVE_WORD.finditer(low)], -1
                for k in at:
                    if k <= done:
                        continue
                    start, end = text.rfind("\n", 0, k) + 1, text.find("\n", k)
                    done = end = len(text) if end < 0 else end
                    for name in {m[0].decode() for m in IDENTIFIER.finditer(text[start:end].encode()) if 4 <= len(m[0]) <= 40}:
                        found[name] = found.get(name, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["name", "n"])

    sums = small_batches(df).select(F.col(text_col).alias("text")).mapInArrow(thrifty(run), "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1")
    best = sums.orderBy(F.desc("n"), "name").limit(n_bytes // 5).collect()  # n_bytes of names of four characters or more, whatever the corpus
    out, size = [], 0
    for r in best:
        if size + len(r["name"]) + 1 > n_bytes:
            break
        out, size = [*out, r["name"]], size + len(r["name"]) + 1
    return " ".join(reversed(out))


class Novelty:
    """Marginal compressed bytes a character; one compressor is used again and again."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 9):
        primer = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.squeeze = zstandard.ZstdCompressor(level=level, dict_data=primer, write_content_size=False, write_checksum=False).compress

    def __call__(self, text: str, start: int, end: int, around: int = AROUND) -> float:
        before, after = text[max(0, start - around) : start].encode(), text[end : end + around].encode()
        code = after + b"\n" + before
        return (len(self.squeeze(code + text[start:end].encode())) - len(self.squeeze(code))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind; end exclusive, in code points."""
    low = text.lower()
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(k in low for k in KEYWORDS) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def folded(text: str) -> str:
    """Lower case, with '_' and '-' as blanks, at the same positions."""
    low = text.lower()
    if len(low) != len(text):  # a letter that grows when lower-cased would shift positions
        low = "".join(c.lower() if c.isascii() else c for c in text)
    return low.replace("_", " ").replace("-", " ")


def values(text: str, low: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, where the name before it starts) of each candidate: the values that '=' cuts a run into, or the whole run where none is long enough."""
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if "=" not in m[0]:
            yield a, b, a
            continue
        pieces, long = list(PIECE.finditer(text, a, b)), False
        for k, piece in enumerate(pieces):
            start, end = piece.span()
            if end - start < (VALUE if k else 16):
                continue
            long = True
            name = k + 1 < len(pieces) and (NAME.fullmatch(piece[0]) or any(s in low[start:end] for s in SENSITIVE))
            if not name:
                yield start, end, pieces[k - 1].start() if k else start
        if not long:
            yield a, b, a


def contexts(text: str) -> tuple[list[int], list[int]]:
    """(starts of the lines that hold text, where each one's context starts: the one above)."""
    starts = [m.start() for m in LINE.finditer(text) if not m[0].isspace()]
    return starts, [0, *starts[:-1]]


def measured(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, float, bool]]:
    """(start, end, novelty, whether a base span holds it whole) of all candidates in sensitive contexts, the assign spans' values included."""
    low = folded(text)
    words = [m.start() for m in SENSITIVE_WORD.finditer(low)]
    if not words:
        return []
    starts, above = contexts(text)
    held = union(base)
    begins = [x for x, _ in held]
    spans: dict[tuple[int, int], bool] = {m.span(2): True for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE} if any(k == "assign" for *_, k in base) else {}
    for a, b, name in values(text, low):
        line = bisect_right(starts, a) - 1
        since = min(name, above[line] if line >= 0 else 0)
        k = bisect_right(words, a) - 1
        if k < 0 or words[k] < since:
            continue
        at = bisect_right(begins, a) - 1
        spans.setdefault((a, b), at >= 0 and held[at][1] >= b)
    return [(a, b, novelty(text, a, b), inside) for (a, b), inside in sorted(spans.items())]


def union(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    held: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if held and a <= held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    return held


def novel_spans(text: str, base: list[tuple[int, int, str]], candidates: list[tuple[int, int, float, bool]], least: float = MIN_NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates that cost at least ``least`` bytes a character, without what the base spans hold of them."""
    held, out, k = union(base), [], 0
    for a, b, cost, inside in candidates:
        if inside or cost < least:
            continue
        while k < len(held) and held[k][1] <= a:
            k += 1
        left, at, i = [], a, k
        while i < len(held) and held[i][0] < b:
            left.append((at, held[i][0]))
            at, i = held[i][1], i + 1
        out += [(x, y, "novel") for x, y in [*left, (at, b)] if any(c.isalnum() for c in text[x:y])]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_NOVELTY, identifiers: str | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_novel, n_measured, novelty, base_sha256, spans) for each row, over whole texts.

    n_measured is the number of candidates that went through the compressor and novelty the largest bytes a
    character among them (null without any). identifiers: the dictionary (None: learnt from df). A null or empty
    text has no spans (empty strings, zero counts). Repeated rows stay; equal texts get equal rows; other
    columns are not read; an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    known = primer(learned_identifiers(df, text_col) if identifiers is None else identifiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                found = measured(text or "", base, novelty)
                new = novel_spans(text or "", base, found, least)
                n = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                rows.append((*n, len(new), len(found), max((c for _, _, c, _ in found), default=None), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new)))
            kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.string()] * 2
            names = ["id", "n_assign", "n_access", "n_hex", "n_novel", "n_measured", "novelty", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    picked = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, n_assign long, n_access long, n_hex long, n_novel long, n_measured long, novelty double, base_sha256 string, spans string"
    return picked.mapInArrow(thrifty(run), schema).withColumnRenamed("id", id_col)


def primer(identifiers: str) -> str:
    return f"{identifiers} {IDENTIFIERS}".strip()


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", least: float = MIN_NOVELTY, identifiers: str | None = None) -> DataFrame:
    """df with every reported span of the text replaced by the mask; overlapping spans become one. All rows and columns stay."""
    at = df.columns.index(text_col)
    known = primer(learned_identifiers(df, text_col) if identifiers is None else identifiers)

    def clean(text: str | None, novelty: Novelty) -> str | None:
        base = base_spans(text or "")
        spans = sorted(base + novel_spans(text or "", base, measured(text or "", base, novelty), least))
        if not spans:
            return text
        out, done = [], 0
        for a, b, _ in spans:
            if a >= done:
                out += [text[done:a], mask]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([clean(x, novelty) for x in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return small_batches(df).mapInArrow(thrifty(run), df.schema)
