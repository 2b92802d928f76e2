"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads the whole text (A-Z lower-cased, blanks and all) in both directions and labels every
byte with language probabilities; a document's probability is the mean over its letter bytes. Texts are
read in windows of ``WINDOW`` bytes that begin at characters, with ``CONTEXT`` bytes more on each side (cut back to a character), from
which the states come in; each position is labelled in the one window that it belongs to. Equal texts of
a part of an Arrow batch are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import split_join
from .common import small_batches, thrifty

#: Bounds of the labelled sample that the network is fitted on: documents a language, and characters taken of each.
FIT_DOCS, FIT_CHARS = 400, 4_000
#: States a direction; bytes of a window and on each side of it; windows read at once.
HIDDEN, WINDOW, CONTEXT, CHUNK = 8, 224, 16, 2_048
#: Training: steps, windows a step and their bytes.
STEPS, BATCH, SPAN = 400, 160, 64
#: A document's sums are rounded to this part, far above what the order of additions changes.
UNIT = 1 << 12
#: Bytes of texts read together.
PART = 2 << 20
UNDETERMINED = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Net:
    """Weights: for each direction W (byte to gates) and U (state to gates), gates in order update, reset, candidate; then O and c."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng, self.langs, self.hidden = np.random.default_rng(seed), langs, hidden
        f32 = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"Wf": f32(0.3, 256, 3 * hidden), "Uf": f32(0.25, hidden, 3 * hidden), "Wb": f32(0.3, 256, 3 * hidden), "Ub": f32(0.25, hidden, 3 * hidden), "O": f32(0.3, 2 * hidden, len(langs)), "c": f32(0, len(langs))}

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States (batch, time, hidden) of one direction, and what the way back needs."""
        n = self.hidden
        W, U = self.p["W" + way], self.p["U" + way]
        h, out, kept = np.zeros((len(x), n), np.float32), [], []
        for t in range(x.shape[1]):
            gx, gh = W[x[:, t]], h @ U
            z, r = _sigmoid(gx[:, :n] + gh[:, :n]), _sigmoid(gx[:, n : 2 * n] + gh[:, n : 2 * n])
            c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
            new = np.where(mask[:, t, None], (1 - z) * c + z * h, h)
            kept.append((h, z, r, c, gh[:, 2 * n :]))
            out.append(h := new)
        return np.stack(out, axis=1), kept

    def _back(self, way: str, x: np.ndarray, mask: np.ndarray, kept: list, dh_out: np.ndarray, grad: dict) -> None:
        n, U = self.hidden, self.p["U" + way]
        dW, dU, dh = np.zeros_like(self.p["W" + way]), np.zeros_like(U), np.zeros((len(x), n), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, c, u = kept[t]
            dh = dh + dh_out[:, t]
            live = mask[:, t, None]
            step = np.where(live, dh, 0)
            dc = step * (1 - z) * (1 - c * c)
            dz, dr = step * (h - c) * z * (1 - z), dc * u * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            dU += h.T @ dg
            np.add.at(dW, x[:, t], np.concatenate([dz, dr, dc], axis=1))
            dh = np.where(live, step * z, dh) + dg @ U.T
        grad["W" + way], grad["U" + way] = dW, dU

    def gradient(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradient. x: bytes (batch, time), padded; size: lengths; y: languages."""
        n, span = self.hidden, np.arange(x.shape[1])
        mask = span[None, :] < size[:, None]
        flip = np.where(mask, size[:, None] - 1 - span[None, :], span[None, :])
        rev = np.take_along_axis(x, flip, axis=1)
        f, kept_f = self._run("f", x, mask)
        b, kept_b = self._run("b", rev, mask)
        both = np.concatenate([f, np.take_along_axis(b, flip[:, :, None], axis=1)], axis=2)
        logit = both @ self.p["O"] + self.p["c"]
        prob = np.exp(logit - logit.max(axis=2, keepdims=True))
        prob /= prob.sum(axis=2, keepdims=True)
        total = mask.sum()
        loss = -np.log(np.take_along_axis(prob, y[:, None, None], axis=2)[:, :, 0] + 1e-12)[mask].sum() / total
        d = prob.copy()
        d[np.arange(len(y)), :, y] -= 1
        d *= mask[:, :, None] / np.float32(total)
        d = d.astype(np.float32)
        grad = {"O": np.einsum("bth,btc->hc", both, d), "c": d.sum(axis=(0, 1))}
        dh = d @ self.p["O"].T
        self._back("f", x, mask, kept_f, dh[:, :, :n], grad)
        self._back("b", rev, mask, kept_b, np.take_along_axis(dh[:, :, n:], flip[:, :, None], axis=1), grad)
        return float(loss), grad

    def train(self, texts: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over random windows of SPAN bytes from the texts of each language, alike many of each; the last losses' mean."""
        rng, losses, pools = np.random.default_rng(seed), [], [np.cumsum([len(t) for t in own]) for own in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            labels = np.arange(batch) % len(texts)
            loss, grad = self.gradient(*matrix([piece(texts[k], pools[k], rng) for k in labels]), labels)
            losses.append(loss)
            pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return float(np.mean(losses[-50:]))

    def _states(self, way: str, x: np.ndarray, alive: list[int]) -> np.ndarray:
        """States (time, hidden, rows) of bytes (time, rows), rows in order of falling length: time step t has the first alive[t] rows."""
        n, W, U = self.hidden, np.ascontiguousarray(self.p["W" + way].T), np.ascontiguousarray(self.p["U" + way].T)
        h, out = np.zeros((n, x.shape[1]), np.float32), np.zeros((x.shape[0], n, x.shape[1]), np.float32)
        for t in range(len(alive)) if way == "f" else reversed(range(len(alive))):
            # Whole groups of rows, so that a row's sums don't depend on how many rows there are beside it.
            k = min(x.shape[1], -(-alive[t] // 64) * 64)
            g, u, now = W.take(x[t, :k], axis=1, mode="clip"), U @ h[:, :k], h[:, :k]
            gates, c = g[: 2 * n], u[2 * n :]
            gates += u[: 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            c *= gates[n:]
            c += g[2 * n :]
            np.tanh(c, out=c)
            now -= c
            now *= gates[:n]
            now += c
            h[:, alive[t] : k] = 0
            out[t, :, :k] = now
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the label probabilities summed over its letter bytes, then their number: (texts, languages + 1)."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        owner, left, start, end, right = windows(data, np.array([len(t) for t in texts], np.int64))
        out, n = np.zeros((len(texts), len(self.langs) + 1)), self.hidden
        order = np.argsort(left - right, kind="stable")
        for k in range(0, len(order), CHUNK):
            pick = order[k : k + CHUNK]
            size = right[pick] - left[pick]
            span = np.arange(size.max(initial=0))[:, None]
            x = data[np.minimum(left[pick] + span, len(data) - 1)]
            own = (span >= start[pick] - left[pick]) & (span < end[pick] - left[pick])
            letters, total = (_LETTER[x] & own).astype(np.float32), np.zeros((len(self.langs) + 1, len(pick)), np.float32)
            x, alive = x.astype(np.intp), (span < size).sum(axis=1).tolist()
            f, b = self._states("f", x, alive), self._states("b", x, alive)
            Of, Ob, c = np.ascontiguousarray(self.p["O"][:n].T), np.ascontiguousarray(self.p["O"][n:].T), self.p["c"][:, None]
            for t in range(len(alive)):
                logit = Of @ f[t]
                logit += Ob @ b[t]
                logit += c
                np.exp(logit, out=logit)  # states are within -1 and 1, so that this can't overflow
                logit *= letters[t] / logit.sum(axis=0)
                total[:-1] += logit
            total[-1] = letters.sum(axis=0)
            np.add.at(out, owner[pick], np.rint(total.T * UNIT))
        return out / UNIT


def windows(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, left, start, end, right) of the windows of texts that stand one after another: [start, end) is the window, [left, right) with its context."""
    ends = np.cumsum(sizes)
    many = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), many)
    first, last = (ends - sizes)[owner], ends[owner]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)

    def at_character(at: np.ndarray) -> np.ndarray:
        at = np.clip(at, first, last)
        for _ in range(3):  # a character has three bytes after its first at most
            inside = (at > first) & (at < last) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)
            at = at - inside
        return at

    start, end = at_character(first + place * WINDOW), at_character(first + (place + 1) * WINDOW)
    return owner, at_character(start - CONTEXT), start, end, at_character(end + CONTEXT)


def piece(texts: list[bytes], ends: np.ndarray, rng: np.random.Generator) -> bytes:
    """A window of SPAN bytes at a random byte of the texts, moved to the text's end where it is too near, that begins at a character."""
    at = int(rng.integers(0, ends[-1]))
    k = int(np.searchsorted(ends, at, "right"))
    text = texts[k]
    start = max(0, min(at - int(ends[k]) + len(text), len(text) - SPAN))
    while start and text[start] & 0xC0 == 0x80:
        start -= 1
    return text[start : start + SPAN]


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes padded with zeros, and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    width = max(1, int(size.max(initial=0)))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), size


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Net:
    """A network from at most fit_docs documents a language, chosen by a hash of the id, so that every language is learned.

    Of a text longer than fit_chars, a piece of that length is taken where a hash of the id says, without the words that it cuts. Rows without text (null or blank) or language are left out. Without any, the network knows no language.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").rlike(r"\S") & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("id", F.lit(1)))
    first = lambda df, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("k") <= fit_docs).drop("k")
    # Ids are chosen without their texts: of each language the smallest hashes, about four times as many as needed, then the first of them.
    keys = rows.select("lang", "h", "id")
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.least(F.lit(4.0 * fit_docs) / F.col("n"), F.lit(1.0)))
    near = split_join(keys, counts, ["lang"], "n", keys.count()).filter((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= F.col("share"))
    best = first(near.select("lang", "h", "id"), "h", "id").distinct()
    spare = F.length("text") - fit_chars
    piece = F.substring("text", (F.pmod(F.xxhash64("id", F.lit(2)), F.greatest(spare, F.lit(0)) + 1) + 1).cast("int"), F.lit(fit_chars))
    uncut = F.regexp_replace(piece, r"^\S*\s+|\s+\S*$", "")
    chosen = rows.withColumn("id", F.coalesce("id", F.lit(""))).join(F.broadcast(best.withColumn("id", F.coalesce("id", F.lit("")))), ["lang", "h", "id"])
    chosen = chosen.withColumn("text", F.when(spare <= 0, F.col("text")).when(F.trim(uncut) != "", uncut).otherwise(piece))
    sample = sorted((r["lang"], r["text"]) for r in first(chosen, "h", "id", "text").select("lang", "text").toLocalIterator())
    langs = sorted({lang for lang, _ in sample})
    net = Net(langs)
    texts = [[t.encode().lower() for x, t in sample if x == lang and t] for lang in langs]
    if langs and all(texts):
        net.train(texts)
    return net


def shares(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of about PART bytes, so that memory doesn't follow the batch; a longer text is a part of its own."""
    k = 0
    while k < len(texts):
        size, a = len(texts[k]), k
        k += 1
        while k < len(texts) and size + len(texts[k]) <= PART:
            size, k = size + len(texts[k]), k + 1
        yield texts[a:k]


def row_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows in parts of about 2 PART bytes of text, as each text is held in several forms; a longer text is a part of its own."""
    ends, a = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * PART, "right")))
        yield batch.slice(a, b - a)
        a = b


def distinct_texts(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(distinct texts with A-Z lower-cased, each text's number). Bytes are lower-cased, as Arrow's ascii_lower fails on a slice of large strings."""
    coded = pc.fill_null(texts, "").cast(pa.large_string()).dictionary_encode()
    return [t.encode().lower() for t in coded.dictionary.to_pylist()], coded.indices.to_numpy()


def predict_language(df: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred string, score double) for each row, from whole texts alone.

    lang_pred is `und` with score 0 where the text is null or has no letter, or the network knows no
    language. Repeated rows stay and equal texts get equal results; ties go to the first language in
    order of name; an empty table gives an empty result.
    """
    names = [id_col, *keep]
    fields = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_parts(whole, len(names))):
            texts = batch.column(len(names))
            n = len(net.langs)
            doc = np.zeros((len(texts), n + 1))
            if n and len(texts):
                raws, own = distinct_texts(texts)
                doc = np.concatenate([net.sums(part) for part in shares(raws)])[own]
            lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts.to_pylist()]
            langs, scores = [], []
            for row, ok in zip(doc, lettered, strict=True):
                if not ok or not n or row[-1] < 1:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(np.argmax(row[:-1]))
                    langs.append(net.langs[best])
                    scores.append(min(1.0, max(0.0, float(row[best] / row[-1]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(f"k{i}" for i in range(len(names))), "lang_pred", "score"])

    picked = small_batches(df).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)), F.col(text_col).alias("text"))
    out = picked.mapInArrow(thrifty(run), ", ".join([*fields, "lang_pred string, score double"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), "lang_pred", "score")
