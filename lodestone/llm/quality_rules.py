"""Quality rules: counts and limits, then the verdict of a hashed n-gram logistic regression.

Counts (words are runs of bytes other than space and \\t \\n \\v \\f \\r): n_words, word_chars (code points in words), n_symbols
(characters of ``[#*$%&|<>]``), n_dup_lines (lines that hold a word and equal an earlier line), n_repeat_words
(words in three-word windows that the text has twice or more). base_failed: fewer than ``least_words`` words, or over half of
them repeated. The verdict on the rest: presence of hashed words, word pairs and runs of three and four bytes,
scaled to length one, in a logistic regression that is trained on a bounded sample of labelled rows (``max_rows``, the
smallest hashes of doc_id) and calibrated (Platt) on a fifth of them, against the fixed threshold ``keep``.

Nulls and edge cases: null and empty texts have no words and fail; null labels are no labels; rows with a null doc_id
take no part; where no label, or only one class, is there, the probability is the share of label 1 (1 without labels).
Repeated rows get a row each. Equal lines and windows of a text are told by 64-bit hashes, those of a million lines agree by chance with 3e-8.
Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_trees import labelled
from lodestone.llm.shared import Slice, map_slices
from lodestone.llm.textops import Words, in_doc, lines, mix, repeats, shingles, span_hashes, window_sum

BITS, ROWS = 15, 256
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def counts(part: Slice) -> dict[str, np.ndarray]:
    words = Words(part.buf, part.offsets)
    n, doc = len(part), words.doc()
    inside = window_sum(((part.buf & 0xC0) != 0x80).astype(np.int64), words.starts, words.ends)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": np.bincount(doc, inside, n).astype(np.int64), "n_symbols": window_sum(_SYMBOL[part.buf].astype(np.int64), part.offsets[:-1], part.offsets[1:])}
    a, b = lines(part.buf, part.offsets)
    with_word = np.searchsorted(words.starts, b) > np.searchsorted(words.starts, a)
    a, b = a[with_word], b[with_word]
    line_doc = np.searchsorted(part.offsets, a, side="right") - 1
    order, group, _ = repeats(line_doc, span_hashes(part.buf, a, b))
    again = np.diff(group, prepend=-1) == 0
    out["n_dup_lines"] = np.bincount(line_doc[order[again]], minlength=n).astype(np.int64)
    at = np.flatnonzero(in_doc(words, 3))
    order, group, many = repeats(doc[at], shingles(words.hashes, 3)[at])
    twice = at[order[many[group] > 1]]
    edge = np.bincount(twice, minlength=len(doc) + 1) - np.bincount(twice + 3, minlength=len(doc) + 1)[: len(doc) + 1]
    out["n_repeat_words"] = np.bincount(doc, np.cumsum(edge)[: len(doc)] > 0, n).astype(np.int64)
    return out


def grams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, number of a flag) for each distinct n-gram that each document has; documents and flags ascend. Takes 2**BITS bytes for each document, so that
    slices must be bounded by rows (ROWS)."""
    out = np.zeros((len(part), 1 << BITS), bool)
    flat, shift = out.ravel(), np.uint64(64 - BITS)
    words = Words(part.buf, part.offsets)
    row = words.doc() << BITS
    for n in (1, 2):
        at = np.flatnonzero(in_doc(words, n))
        flat[row[at] + (mix(shingles(words.hashes, n)[at] + np.uint64(n)) >> shift).astype(np.int64)] = True
    row = np.repeat(np.arange(len(part)) << BITS, np.diff(part.offsets))
    code = part.buf.astype(np.uint64)
    for n in (2, 3, 4):
        code = (code[:-1] << np.uint64(8)) | part.buf[n - 1 :] if len(code) else code
        if n > 2 and len(code):
            same = row[: len(code)] == row[n - 1 :]
            flat[row[: len(code)][same] + (mix(code[same] + np.uint64(n << 40)) >> shift).astype(np.int64)] = True
    at = np.flatnonzero(flat)
    return at >> BITS, at & ((1 << BITS) - 1)


class Regression:
    """Weights of the flags, and the line that turns a margin into a calibrated log-odds."""

    def __init__(self) -> None:
        self.weights, self.base, self.slope, self.shift, self.constant = np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0, None

    def probability(self, doc: np.ndarray, flag: np.ndarray, n: int) -> np.ndarray:
        """Of each of n documents, given as the pairs of grams()."""
        if self.constant is not None:
            return np.full(n, self.constant)
        z = np.bincount(doc, self.weights[flag], n) / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1)) + self.base
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the log loss, with Platt's smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target))
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.5, seed: int = 5) -> Regression:
    """Adagrad on the log loss over four fifths of the rows (each: the numbers of its flags); the rest calibrates."""
    out = Regression()
    if len(np.unique(y)) < 2:
        out.constant = float(y.mean()) if len(y) else 1.0
        return out
    rng, train = np.random.default_rng(seed), np.flatnonzero(np.arange(len(y)) % 5 != 4)
    seen, seen_base = np.full(1 << BITS, 1e-3, np.float32), 1e-3

    def margins(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = np.array([len(rows[i]) for i in some])
        scale = 1 / np.sqrt(np.maximum(many, 1))
        at, doc = np.concatenate([rows[i] for i in some]).astype(np.int64), np.repeat(np.arange(len(some)), many)
        return np.bincount(doc, out.weights[at], len(some)) * scale + out.base, at, np.repeat(scale, many) * 1.0

    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), batch):
            some = train[a : a + batch]
            z, at, scale = margins(some)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            grad = np.bincount(at, np.repeat(d, [len(rows[i]) for i in some]) * scale, 1 << BITS).astype(np.float32)
            seen += grad**2
            out.weights -= rate * grad / np.sqrt(seen)
            seen_base += d.sum() ** 2
            out.base -= rate * d.sum() / np.sqrt(seen_base)
    back = np.flatnonzero(np.arange(len(y)) % 5 == 4)
    if len(np.unique(y[back])) == 2:
        out.slope, out.shift = _platt(np.concatenate([margins(back[a : a + 256])[0] for a in range(0, len(back), 256)]), y[back])
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int | None = None, held_out: int = 0, max_rows: int = 4_000, **how) -> Regression:
    """Fits the regression on the driver to at most ``max_rows`` rows of flags (at most 64 kB each), which Spark makes."""
    sample = labelled(labels, label, of, held_out, max_rows)  # at most max_rows pairs of numbers: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            doc, flag = grams(part)
            flags = [f.tobytes() for f in np.split(flag.astype(np.uint16), np.searchsorted(doc, np.arange(1, len(part))))]
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(flags, pa.binary())], ["doc_id", "flags"])

        return each

    rows = map_slices(texts, make, "doc_id long, flags binary", rows=ROWS).join(F.broadcast(sample), "doc_id").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(x.as_buffer(), np.uint16) for x in rows["flags"]], rows["y"].to_numpy().astype(np.float64), **how)


def judge(docs: DataFrame, labels: DataFrame, keep: float = 0.5, least_words: int = 50, **how) -> DataFrame:
    """doc_id, the five counts, base_failed, probability (null where base_failed) and kept for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **how))

    def make():
        model = sent.value

        def each(part: Slice) -> pa.RecordBatch:
            found = counts(part)
            failed = (found["n_words"] < least_words) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            p = model.probability(*grams(part), len(part))
            arrays = [pa.array(part.ids), *(pa.array(v) for v in found.values()), pa.array(failed), pa.array(p, mask=failed), pa.array(~failed & (p >= keep))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *found, "base_failed", "probability", "kept"])

        return each

    return map_slices(docs, make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean", rows=ROWS)
