"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics (see FEATURES) come from the whole text, in numpy, slice by slice. Trees are learned on a bounded
sample of labelled rows (``max_rows`` rows with the smallest hashes of doc_id) and kept as flat arrays in heap
order, so that scoring walks all trees for all documents of a slice at once.

Nulls and edge cases: a null text counts as empty; an empty text gets the score that the trees give to zero
statistics; rows with a null doc_id take no part; null labels are no labels; where no label, or only one class,
is there, every score is the share of label 1 (0.5 without labels). Extra columns are ignored. Repeated rows get a row each, with equal scores. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Slice, learns, map_slices
from lodestone.llm.textops import Words, byte_counts, in_doc, lines, repeats, shingles, span_hashes

FEATURES = (
    "log_words", "word_bytes", "upper", "symbols", "exclaims", "digits", "punctuation", "bars", "non_ascii", "line_words", "sentence_words",
    "distinct_words", "top_word", "same_as_last", "repeated_3_words", "repeated_lines", "long_words", "ends_odd",
)
_CLASSES = {
    "upper": range(65, 91), "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "symbol": b"#*$%&|<>", "exclaim": b"!", "digit": b"0123456789",
    "punct": b"!\"'(),-./:;?[]_`{}~", "bar": b"|", "high": range(128, 256), "newline": b"\n", "stop": b".?!",
}
_BY_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _BY_CLASS[list(_v), _k] = 1
_LETTER = _BY_CLASS[:, list(_CLASSES).index("letter")] > 0
_PLAIN_END = _LETTER | np.isin(np.arange(256), list(b".,;:?"))


def statistics(part: Slice) -> np.ndarray:
    """(documents, FEATURES) of a slice; all zero for a text without words."""
    n = len(part)
    c = dict(zip(_CLASSES, (byte_counts(part.buf, part.offsets) @ _BY_CLASS).T, strict=True))
    words = Words(part.buf, part.offsets)
    doc, count = words.doc(), np.maximum(words.counts, 1)
    letters, size = np.maximum(c["letter"], 1), np.maximum(np.diff(part.offsets), 1)
    long = words.ends - words.starts
    per_doc = lambda v: np.bincount(doc, v, n)
    order, group, many = repeats(doc, words.hashes)
    top = np.zeros(n)
    first = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else group
    np.maximum.at(top, doc[order[first]], many)
    again = np.zeros(len(doc))
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    three = np.flatnonzero(in_doc(words, 3))
    s_order, s_group, s_many = repeats(doc[three], shingles(words.hashes, 3)[three])
    twice = np.bincount(doc[three[s_order]], s_many[s_group] > 1, n)
    a, b = lines(part.buf, part.offsets)
    line_doc = np.searchsorted(part.offsets, a, side="right") - 1
    l_order, l_group, l_many = repeats(line_doc, span_hashes(part.buf, a, b))
    copied = np.bincount(line_doc[l_order], (b - a)[l_order] * (l_many[l_group] > 1), n)
    cols = [
        np.log1p(words.counts), per_doc(long) / count, c["upper"] / letters, c["symbol"] / count, c["exclaim"] / count, c["digit"] / size, c["punct"] / count, c["bar"] / count,
        c["high"] / size, words.counts / (c["newline"] + 1), words.counts / (c["stop"] + 1), np.bincount(doc[order[first]], minlength=n) / count, top / count, per_doc(again) / count,
        twice / count, copied / size, per_doc(long > 20) / count, per_doc(~_PLAIN_END[part.buf[words.ends - 1]]) / count,
    ]
    out = np.column_stack([np.asarray(x, np.float64) for x in cols])
    out[words.counts == 0] = 0
    return out


class Trees:
    """Boosted trees in heap order: feature and threshold of 2**depth - 1 inner nodes, 2**depth leaves a tree."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.leaf = (np.zeros((0, 2**depth - 1), np.int32), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))

    def add(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.feature, self.threshold, self.leaf = (np.vstack([old, new[None]]) for old, new in ((self.feature, feature), (self.threshold, threshold), (self.leaf, leaf)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. All trees are walked together, one step for each level."""
        out = np.full(len(x), self.base)
        if len(self.leaf):
            row, tree = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            out = out + self.leaf[tree, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: float = 1.0, penalty: float = 1.0) -> Trees:
    """Newton boosting of the log loss over histograms of quantile bins. ``least``: smallest sum of second
    derivatives in a child; ``penalty``: added to it in each leaf value."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    out = Trees(float(np.log(share / (1 - share))), depth)
    if len(np.unique(y)) < 2:
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # bin <= k iff value <= cuts[k]
    total = np.full(len(y), out.base)
    width = x.shape[1] * bins
    cell = binned + np.arange(x.shape[1]) * bins
    usable = np.zeros(width, bool)
    for j, c in enumerate(cuts):
        usable[j * bins : j * bins + len(c)] = True
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within the level
        feature, threshold = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            n = 2**level
            at = (node[:, None] * width + cell).ravel()
            hist = [np.bincount(at, np.repeat(v, x.shape[1]), n * width).reshape(n, x.shape[1], bins).cumsum(2) for v in (g, h)]
            (gl, hl), (ga, ha) = hist, [v[:, :1, -1:] for v in hist]
            gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
            gain[(hl < least) | (ha - hl < least)] = 0
            gain = gain.reshape(n, width) * usable
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(n), best] > 1e-6):
                j, b = divmod(int(best[k]), bins)
                feature[n - 1 + k], threshold[n - 1 + k] = j, cuts[j][b]
            at = n - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > threshold[at])
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = -rate * gs / (hs + penalty)
        out.add(feature, threshold, leaf)
        total = total + leaf[node]
    return out


def labelled(labels: DataFrame, label: str, of: int | None, held_out: int, max_rows: int) -> DataFrame:
    """A bounded sample of labelled rows: the ``max_rows`` smallest hashes of doc_id among the rows to learn from
    (all rows where ``of`` is None). Columns doc_id and y."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if of is not None:
        rows = rows.where(learns(of, held_out))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int | None = 3, held_out: int = 1, max_rows: int = 20_000) -> Trees:
    """Fits the trees on the driver to at most ``max_rows`` rows of statistics (18 numbers each), which Spark makes."""
    sample = labelled(labels, label, of, held_out, max_rows)  # at most max_rows pairs of numbers: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(statistics(part).tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])

        return each

    rows = map_slices(texts, make, "doc_id long, x array<double>").join(F.broadcast(sample), "doc_id").toPandas().sort_values("doc_id")
    if rows.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(rows.x.tolist()), rows.y.to_numpy(np.float64))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score for every row of docs."""

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(trees.score(statistics(part)))], ["doc_id", "score"])

        return each

    return map_slices(docs, make, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, score, predicted (1: good) for every row of docs, by trees learned from ``labels``."""
    return score(docs, learn(docs, labels, **how)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
