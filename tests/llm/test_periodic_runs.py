"""Periodic runs against brute force over every lag."""

import hashlib
import random
import re
import zlib

import pytest

from lodestone.llm import periodic_runs, queries
from lodestone.llm.shared import Slice

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(words):
    n, found = len(words), {}
    for p in range(1, n):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j > i and j - i + p >= max(12, 2 * p):
                found.setdefault((i - p, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in found.items())


def cut(words, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def runs_of(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    part = Slice(np.arange(len(raw)), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends, group, doc = periodic_runs.earlier(part)
    return [periodic_runs.diagonals(r.split(), ends[doc == d], group[doc == d]) for d, r in enumerate(raw)]


def texts(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        some = [f"{c}" for c in "abcdefgh"[: rnd.randint(1, 8)]]
        out = []
        while len(out) < rnd.randint(5, 160):
            piece = [rnd.choice(some) for _ in range(rnd.randint(1, 14))]
            out += piece * rnd.choice([1, 1, 2, 3, 9]) + (out[-rnd.randint(1, 60) :] if rnd.random() < 0.3 else [])
        yield " ".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    some = list(texts(seed, 400))
    for text, got in zip(some, runs_of(some), strict=True):
        assert got == naive(text.split()), text


def test_named_texts():
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 300:
        fib.append(fib[-1] + " " + fib[-2])
    power = [" ".join(["x"] * 40 + ["y"]) for _ in range(5)]
    some = [fib[-1], " ".join(power), "x " * 300, "a b a c " * 60, " ".join("a a b".split() * 20 + ["a", "b", "a"] * 20), "p q r s t u " * 2, "p q r s t " * 2, "p q r s t " * 2 + "p q"]
    for text, got in zip(some, runs_of(some), strict=True):
        assert got == naive(text.split()), text


def test_a_repeated_word_has_one_diagonal():
    import time

    began = time.time()
    (got,) = runs_of(["x " * 200_000])
    assert got == [(0, 200_000, 1)] and time.time() - began < 20


SCHEMA = "doc_id long, text string, runs int, collapsed string, n_words string"


def test_rows(spark):
    texts_ = [None, "", " \n\t", "one", "a b " * 6, "a\tb\nc " * 4 + "d", "é ü " * 50, "x" * 100_000, "a b c d e f g h i j k l " * 1000]
    rows = [(i, t, 1, "c", "n") for i, t in enumerate(texts_)]
    docs = spark.createDataFrame([*rows, rows[4], (None, "a " * 30, 1, "c", "n")], SCHEMA)
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.detect(docs).collect())
    want = []
    for d, t, *_ in [*rows, rows[4]]:
        words = WORD.findall(t or "")
        want.append((d, len(words), naive(words) if len(words) < 2000 else [(0, 12_000, 12)], cut(words, naive(words)) if len(words) < 2000 else " ".join(words[:12])))
    assert got == sorted(want)
    assert periodic_runs.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 90))) if i % 17 else None) for i in range(-40, 160)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = naive(words), got[d]
        top = min(((-m, s, p) for s, m, p in runs), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(cut(words, runs).encode()).hexdigest()
