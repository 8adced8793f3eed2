"""The classifiers and the packing against naive versions, held-out accuracy, and bounds on memory."""

import random
import subprocess
import sys
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from lodestone.llm import bin_packing, language_kernel, quality_rules, quality_trees, toxicity_cnn
from lodestone.llm.shared import Slice, slices

D = "/root/testdata/sf0.01"


def part(*texts):
    raw = [t.encode() for t in texts]
    return Slice(np.arange(len(raw)), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


TEXTS = ("the cat sat on the mat", "", "a", "Der Hund lief über die Straße!", "x y", "one two three four five six seven eight nine ten 11", "...", "the cat sat on the mat the cat")


def naive_score(net, buckets):
    """One document's logit: every filter at every place, one number at a time."""
    e = [[sum(float(net.table[b][d]) for b in row) for d in range(toxicity_cnn.DIM)] for row in buckets]
    total, f = float(net.base), toxicity_cnn.FILTERS
    for k, w in enumerate(toxicity_cnn.WIDTHS):
        for c in range(f):
            best = None
            for i in range(len(e) - w + 1):
                v = float(net.bias[k * f + c])
                for j in range(w):
                    v += sum(e[i + j][d] * float(net.filters[d, toxicity_cnn._AT[w] + j * f + c]) for d in range(toxicity_cnn.DIM))
                best = v if best is None else max(best, v)
            total += max(0.0, best or 0.0) * float(net.out[k * f + c])
    return total


def test_convolution():
    net = toxicity_cnn.Net(3)
    buckets, offsets = toxicity_cnn.tokens(part(*TEXTS))
    got = net.raw(buckets, offsets)
    for i in range(len(TEXTS)):
        assert got[i] == pytest.approx(naive_score(net, buckets[offsets[i] : offsets[i + 1]]), abs=1e-4)


def test_gradient():
    """A step's gradients, read back from Adagrad's sums, against finite differences of the loss."""
    net = toxicity_cnn.Net(5)
    for name in ("table", "filters", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias[:] = 0.1  # no pool stands at its kink
    y = np.array([1.0, 0, 1, 0, 1, 0, 1, 0])
    buckets, offsets = toxicity_cnn.tokens(part(*TEXTS))

    def loss():
        maps = net.maps(buckets, offsets)
        z = np.maximum(toxicity_cnn._reduce(np.maximum, maps, offsets, 0), 0).astype(np.float64) @ net.out + float(net.base)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    seen = {k: np.zeros_like(getattr(net, k)) for k in ("table", "filters", "bias", "out")} | {"base": np.zeros(1)}
    before = {k: getattr(net, k).copy() for k in ("table", "filters", "bias", "out")}
    spots = {"out": [(3,), (9,), (20,)], "bias": [(2,), (11,)], "filters": [(0, 0), (3, 10), (5, 30)], "table": [(int(buckets[0, 0]), 2), (int(buckets[4, 1]), 5)]}
    slope = {}
    for name, at in spots.items():
        for spot in at:
            values = []
            for step in (1e-3, -1e-3):
                getattr(net, name)[spot] = before[name][spot] + step
                values.append(loss())
            getattr(net, name)[spot] = before[name][spot]
            slope[name, spot] = (values[0] - values[1]) / 2e-3
    net.step(buckets, offsets, y, 0.0, seen)
    for (name, spot), want in slope.items():
        assert np.sqrt(seen[name][spot]) == pytest.approx(abs(want), rel=0.05, abs=2e-4), (name, spot)


def test_kernel():
    p = part(*TEXTS)
    flags = language_kernel.presence(p)
    naive = []
    for t in TEXTS:
        read = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in t.encode())
        grams = {read[i : i + n] for n in (1, 2, 3) for i in range(len(read) - n + 1)}
        code = lambda g: int(language_kernel.mix(np.array([int.from_bytes(g, "big") + (len(g) << 40)], np.uint64))[0] >> np.uint64(64 - language_kernel.BITS))
        naive.append({code(g) for g in grams})
    assert [set(np.flatnonzero(f).tolist()) for f in flags] == naive
    kernel = language_kernel.Kernel(["a"], flags[:4].astype(np.float32), np.zeros((4, 1)))
    values = kernel.values(flags)
    for i, a in enumerate(naive):
        for j, b in enumerate(naive[:4]):
            assert values[i, j] == pytest.approx(len(a & b) / max(1, len(a) * len(b)) ** 0.5, abs=1e-5)


def test_kernel_ridge():
    """The Nyström features with all rows as landmarks give kernel ridge regression itself."""
    rng = np.random.default_rng(0)
    flags = rng.random((24, 1 << language_kernel.BITS)) < 0.02
    flags[:12, :300] |= rng.random((12, 300)) < 0.5
    langs = ["a"] * 12 + ["b"] * 12
    found = language_kernel.fit(flags, langs, landmarks=24, ridge=1e-2)
    k = found.values(flags)[:, np.argsort(np.lexsort((np.repeat([0, 1], 12), np.tile(np.arange(12), 2))))]
    y = np.where(np.array(langs)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    want = k @ np.linalg.solve(k + 1e-2 * 24 * np.eye(24), y)
    assert np.allclose(found.values(flags) @ found.weights, want, atol=1e-3)


def walk(trees, x):
    """One row through every tree, from node to node."""

    def down(t, node):
        if node >= 2**trees.depth - 1:
            return trees.leaf[t][node - (2**trees.depth - 1)]
        return down(t, 2 * node + 1 + int(x[trees.feature[t][node]] > trees.threshold[t][node]))

    return 1 / (1 + np.exp(-np.clip(trees.base + sum(down(t, 0) for t in range(len(trees.leaf))), -30, 30)))


def test_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (rng.random(300) < 0.05)).astype(float)
    trees = quality_trees.fit(x, y, rounds=15, depth=3, bins=64)
    assert np.allclose(trees.score(x), [walk(trees, r) for r in x])
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    # the first split of the first tree is the best of all
    p = 1 / (1 + np.exp(-trees.base))
    g, h = p - y, np.full(300, p * (1 - p))
    gain = {}
    for j in range(5):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain[j, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
    best = max(gain.values())
    left = x[:, trees.feature[0][0]] <= trees.threshold[0][0]
    got = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
    assert got == pytest.approx(best, rel=0.02)


def test_rules_verdict(spark):
    """The verdict on labelled rows that it has not learned from, among those that no count fails."""
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = quality_rules.judge(docs, labels, of=3, held_out=1).join(labels, "doc_id").where("not base_failed and quality is not null").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) > 30 and np.mean([r.kept == (r.quality == 1) for r in out]) > 0.9


def test_regression():
    """Pairs of documents and flags give the same probability as a sum for each document."""
    rng, model = np.random.default_rng(1), quality_rules.Regression()
    model.weights = rng.normal(size=1 << quality_rules.BITS).astype(np.float32)
    model.base, model.slope, model.shift = 0.3, 1.7, -0.2
    doc, flag = quality_rules.grams(part(*TEXTS))
    got = model.probability(doc, flag, len(TEXTS))
    for i in range(len(TEXTS)):
        own = flag[doc == i]
        z = sum(float(model.weights[k]) for k in own) / max(1, len(own)) ** 0.5 + 0.3
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(1.7 * z - 0.2))), abs=1e-5)


def fewest(lengths, room):
    """The fewest bins, by trying everything."""
    pieces = sorted(lengths, reverse=True)

    @lru_cache(None)
    def go(k, gaps):
        if k == len(pieces):
            return 0
        tries = [1 + go(k + 1, tuple(sorted((*gaps, room - pieces[k]))))]
        for i, g in enumerate(gaps):
            if g >= pieces[k] and (i == 0 or gaps[i - 1] != g):
                tries.append(go(k + 1, tuple(sorted((*gaps[:i], g - pieces[k], *gaps[i + 1 :])))))
        return min(tries)

    return go(0, ())


def test_fewest_bins():
    rnd, gap = random.Random(6), 0
    for _ in range(120):
        room = rnd.choice([20, 30, 50])
        pieces = [rnd.randint(2, room) if rnd.random() < 0.3 else rnd.randint(room // 6, room // 2 + 1) for _ in range(rnd.randint(5, 11))]
        best = bin_packing.pack(Counter(pieces), room)
        assert Counter(x for p, n in best.items() for x in p for _ in range(n)) == Counter(pieces) and all(sum(p) <= room for p in best)
        want = fewest(pieces, room)
        assert bin_packing.least_bins(Counter(pieces), room) <= want
        gap += sum(best.values()) - want
    assert gap == 0


def test_slices_bound_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["ab"] * 1000)], ["doc_id", "text"])
    got = list(slices(batch, rows=300))
    assert [len(s) for s in got] == [300, 300, 300, 100] and np.concatenate([s.ids for s in got]).tolist() == list(range(1000))


TINY = """
import numpy as np, pyarrow as pa
from lodestone.llm import language_kernel as k, quality_rules as q
from lodestone.llm.shared import slices
batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["a b cd"] * 10_000)], ["doc_id", "text"])
model, kernel = q.Regression(), k.Kernel(["en"], np.ones((96, 1 << k.BITS), np.float32), np.ones((96, 1)))
for s in slices(batch, rows=q.ROWS):
    q.counts(s), model.probability(*q.grams(s), len(s))
for s in slices(batch, rows=k.ROWS):
    kernel.predict(k.presence(s))
print(next(int(line.split()[1]) // 1024 for line in open("/proc/self/status") if line.startswith("VmHWM")))  # its own peak; ru_maxrss begins at its parent's
"""


def test_tiny_texts_take_little_memory():
    out = subprocess.run([sys.executable, "-c", TINY], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300
