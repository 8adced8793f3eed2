"""Toxicity: a convolutional text classifier in numpy.

A word is a run of letters (A-Z lower-cased, or any byte of a non-ASCII character). Its embedding is the sum of
three rows of one hashed table: of the word, of its first four and of its first five bytes. Filters of widths
1, 2 and 3 run over the whole text; each is max-pooled and a logistic unit reads the pools. The table's first
coordinate starts from how far a bucket's toxic documents exceed their expected number; all weights are then trained by
Adagrad on a bounded sample of labelled rows (``max_rows``, the smallest hashes of doc_id).

Thresholds are calibrated by language: rows held back from training set one threshold (in logits) for each
language, and the reported score is shifted by it, so that 0.5 is the threshold everywhere. A language with fewer than FEW held-back rows of either
class takes the threshold of all held-back rows. The language is
guessed from the words of the text (naive Bayes over hashed words); the column lang is only a label to learn that from.

Nulls and edge cases: null texts count as empty; a text without letters gets the score of empty pools; null labels are no
labels, a null lang teaches no language; rows with a null doc_id take no part; where no label, or only one class, is
there, every score is the share of label 1 (0 without labels). Extra columns are ignored. Repeated rows get a row each, with equal scores. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_trees import labelled
from lodestone.llm.shared import Slice, map_slices
from lodestone.llm.textops import LOWER, mix, runs, span_hashes

BITS, DIM, FILTERS, WIDTHS, LANG_BITS, FEW = 18, 8, 8, (1, 2, 3), 12, 5
#: (prefix bytes or None, salt) of the rows that a word's embedding sums up.
_PARTS = ((None, 11), (4, 12), (5, 13))
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
#: Columns of the joint filter matrix: for each width, FILTERS columns for each place in the window.
_AT = {w: FILTERS * w * (w - 1) // 2 for w in WIDTHS}


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words, 3) of a slice and the offsets of its documents in them."""
    buf = LOWER[part.buf]
    starts, ends = runs(_LETTER[buf], part.offsets)
    hashes = [span_hashes(buf, starts, ends if n is None else np.minimum(ends, starts + n)) for n, _ in _PARTS]
    buckets = [(mix(h + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int32) for h, (_, salt) in zip(hashes, _PARTS, strict=True)]
    return np.column_stack(buckets) if len(starts) else np.zeros((0, len(_PARTS)), np.int32), np.searchsorted(starts, part.offsets)


def _reduce(op: np.ufunc, x: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
    """op over each document's rows; ``empty`` for a document without rows."""
    out = np.full((len(offsets) - 1, x.shape[1]), empty, x.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = op.reduceat(x, offsets[full], axis=0)
    return out


class Net:
    """Weights, thresholds and the language guesser; small enough to travel with a task (about 9 MB)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (rng.normal(size=(1 << BITS, DIM)) * 0.05).astype(np.float32)
        self.filters = (rng.normal(size=(DIM, FILTERS * sum(WIDTHS))) * 0.3).astype(np.float32)
        self.filters[0, 0] = 1
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (rng.normal(size=FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.out[0] = 1
        self.base = np.float32(0)
        self.lang, self.shift, self.constant = np.zeros((1, 1 << LANG_BITS), np.float32), np.zeros(1), None

    def maps(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Filter outputs at every place (words, filters); -inf where a window leaves its document."""
        e = self.table[buckets[:, 0]] + self.table[buckets[:, 1]] + self.table[buckets[:, 2]]
        all_places, left = e @ self.filters, np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(e))
        out = np.empty((len(e), len(self.bias)), np.float32)
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            out[:, own] = all_places[:, _AT[w] : _AT[w] + FILTERS] + self.bias[own]
            for j in range(1, w):
                out[: len(e) - j, own] += all_places[j:, _AT[w] + j * FILTERS : _AT[w] + (j + 1) * FILTERS]
            out[left < w, own] = -np.inf
        return out

    def languages(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = _reduce(np.add, self.lang[:, buckets[:, 0] >> (BITS - LANG_BITS)].T, offsets, 0)
        return total.argmax(1)

    def raw(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.maximum(_reduce(np.maximum, self.maps(buckets, offsets), offsets, 0), 0) @ self.out + self.base

    def score(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        z = self.raw(buckets, offsets).astype(np.float64) - self.shift[self.languages(buckets, offsets)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def step(self, buckets: np.ndarray, offsets: np.ndarray, y: np.ndarray, rate: float, seen: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the log loss. Only the places that win a pool get a gradient."""
        maps = self.maps(buckets, offsets)
        top = _reduce(np.maximum, maps, offsets, 0)
        z = np.maximum(top, 0) @ self.out + self.base
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) / len(y)
        place, which = np.nonzero(maps == np.repeat(top, np.diff(offsets), axis=0))
        doc = np.searchsorted(offsets, place, side="right") - 1
        winner = np.full(top.shape, -1)
        winner[doc[::-1], which[::-1]] = place[::-1]  # the first of equal places stays
        doc, which = np.nonzero((top > 0) & (winner >= 0))
        place, g = winner[doc, which], d[doc] * self.out[which]
        grads = {"out": d @ np.maximum(top, 0), "bias": np.bincount(which, g, len(self.bias)).astype(np.float32), "filters": np.zeros_like(self.filters)}
        rows, row_grads = [], []
        for k, w in enumerate(WIDTHS):
            own = (which // FILTERS) == k
            for j in range(w):
                column = _AT[w] + j * FILTERS + which[own] % FILTERS
                at, gj = buckets[place[own] + j], g[own][:, None]
                e = self.table[at].sum(1)
                np.add.at(grads["filters"].T, column, gj * e)
                rows += [at.ravel()]
                row_grads += [np.repeat(gj * self.filters.T[column], at.shape[1], axis=0)]
        for name, grad in grads.items():
            seen[name] += grad**2
            setattr(self, name, getattr(self, name) - rate * grad / np.sqrt(seen[name] + 1e-6))
        self.base -= np.float32(rate) * d.sum() / np.sqrt(seen["base"].__iadd__(d.sum() ** 2)[0] + 1e-6)
        at, back = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(at), DIM), np.float32)
        np.add.at(total, back, np.concatenate(row_grads))
        seen["table"][at] += total**2
        self.table[at] -= rate * total / np.sqrt(seen["table"][at] + 1e-6)


def _gather(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors; the middle of the widest gap among equally good ones."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    edge = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gap = np.where(errors == errors.min(), np.diff(edge), -1)
    k = int(gap.argmax())
    return float((edge[k] + edge[k + 1]) / 2)


def fit(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], epochs: int = 6, batch: int = 128, rate: float = 0.05, seed: int = 7) -> Net:
    """Trains on four fifths of the rows and calibrates on the last fifth."""
    net = Net(seed)
    if len(np.unique(y)) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    counts = np.zeros((2, 1 << BITS))
    known = sorted({x for x in langs if x is not None})
    words = np.full((max(1, len(known)), 1 << LANG_BITS), 0.5)
    for t, label, lang in zip(docs, y, langs, strict=True):
        if lang is not None:
            words[known.index(lang)] += np.bincount(t[:, 0] >> (BITS - LANG_BITS), minlength=1 << LANG_BITS)
    net.lang = np.log(words / words.sum(1, keepdims=True)).astype(np.float32)
    back = np.arange(len(y)) % 5 == 4
    for t, label in ((docs[i], int(y[i])) for i in np.flatnonzero(~back)):
        counts[label, np.unique(t)] += 1
    expected = counts.sum(0) * y[~back].mean()
    excess = (counts[1] - expected) / np.sqrt(expected + 1)
    net.table[:, 0] = np.where(counts.sum(0) > 0, np.sign(excess) * np.log1p(np.abs(excess)), 0) / len(_PARTS)
    seen = {k: np.full_like(getattr(net, k), 0.01) for k in ("table", "filters", "bias", "out")} | {"base": np.full(1, 0.01, np.float32)}
    rng, train = np.random.default_rng(seed), np.flatnonzero(~back)
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), batch):
            some = train[a : a + batch]
            net.step(*_gather([docs[i] for i in some]), y[some], rate, seen)
    held = [docs[i] for i in np.flatnonzero(back)] if back.any() else docs
    y_held = y[back] if back.any() else y
    z = np.concatenate([net.raw(*_gather(held[a : a + batch])) for a in range(0, len(held), batch)])
    guess = np.concatenate([net.languages(*_gather(held[a : a + batch])) for a in range(0, len(held), batch)])
    overall = _threshold(z, y_held)
    few = lambda k: y_held[guess == k].sum() < FEW or (1 - y_held[guess == k]).sum() < FEW
    net.shift = np.array([overall if few(k) else _threshold(z[guess == k], y_held[guess == k]) for k in range(len(net.lang))])
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int | None = 5, held_out: int = 0, max_rows: int = 6_000, **how) -> Net:
    """Fits the net on the driver to at most ``max_rows`` labelled texts, already cut into buckets by Spark."""
    sample = labelled(labels, label, of, held_out, max_rows)  # at most max_rows pairs of numbers: small enough to broadcast
    texts = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [])).join(F.broadcast(sample), "doc_id")

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            buckets, offsets = tokens(part)
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array([buckets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["doc_id", "tokens"])

        return each

    lang = texts.groupBy("doc_id").agg(F.max("y").alias("y"), (F.max("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
    rows = map_slices(texts, make, "doc_id long, tokens binary").join(F.broadcast(lang), "doc_id").toArrow().sort_by("doc_id")
    cut = [np.frombuffer(t.as_buffer(), np.int32).reshape(-1, len(_PARTS)) for t in rows["tokens"]]
    return fit(cut, rows["y"].to_numpy().astype(np.float64), rows["lang"].to_pylist(), **how)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size: 2**BITS rows of DIM numbers

    def make():
        net = sent.value

        def each(part: Slice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(net.score(*tokens(part)))], ["doc_id", "score"])

        return each

    return map_slices(docs, make, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, score, predicted (1: toxic) for every row of docs, by a net learned from ``labels``."""
    return score(docs, learn(docs, labels, **how)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
