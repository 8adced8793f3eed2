"""Exact dedup against brute force: odd rows, long chains of equal keys, split buckets, dealt keys."""

import hashlib
import string
from collections import Counter

import pytest

from lodestone.llm import exact_dedup, shared

SCHEMA = "doc_id long, text string, key string, kept int, n long, bucket string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus():
    texts = [f"Text {i % 40} ÄÖ" for i in range(120)] + [f"TEXT {i % 40} äö" for i in range(60)] + [f"text {i % 40} ÄÖ" for i in range(60)]
    texts += [None, "", "", " ", "x" * 300_000, "X" * 300_000, "x" * 299_999 + "y", "İstanbul", "i̇stanbul", "ss", "ß"] + ["the same"] * 200
    rows = [(i * 7 % 1009 - 300, t, "k", 1, 5, "b") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "Text 1 ÄÖ", "k", 1, 5, "b")]


def naive(rows):
    norm = [(r[0], (r[1] or "").translate(LOWER)) for r in rows if r[0] is not None]
    keep, many = {}, Counter(t for _, t in norm)
    for d, t in norm:
        keep[t] = max(keep.get(t, d), d)
    return sorted((d, keep[t], many[t], d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.mark.parametrize(("capacity", "bits"), [(1 << 16, 63), (4, 63), (2, 3), (1, 1)])
def test_groups(docs, capacity, bits):
    assert sorted(map(tuple, exact_dedup.dedup(docs, capacity, bits).collect())) == naive(corpus())


def test_dealt_keys_and_shuffled_texts(docs, monkeypatch):
    monkeypatch.setattr(shared, "MOST_OF_KEY", 10)
    monkeypatch.setattr(exact_dedup, "BROADCAST", 0)
    assert sorted(map(tuple, exact_dedup.dedup(docs, 8).collect())) == naive(corpus())


@pytest.mark.parametrize(("capacity", "bits"), [(1, 63), (5, 63), (5, 4), (1000, 63)])
def test_directory(docs, capacity, bits):
    index = exact_dedup.build(docs, capacity, bits)
    slots = [(r.depth, r.prefix, r.entries) for r in index.directory.collect()]
    ranges = sorted((p << exact_dedup.BITS - d, (p + 1) << exact_dedup.BITS - d) for d, p, _ in slots)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    keys, entries = {r.key for r in index.rows.collect()}, index.entries.collect()
    last = max(d for d, _, _ in slots)
    for d, p, n in slots:
        inside = [r for r in entries if r.key >> exact_dedup.BITS - d == p]
        assert len(inside) == n and (n <= capacity or d == last)
    assert sum(n for _, _, n in slots) == len(entries)
    assert {r.key for r in entries} == keys and sum(r.group_size for r in entries) == index.rows.count()
    assert all(any(a == r.bucket and a <= r.key < b for a, b in ranges) for r in entries)
    chains = {}
    for r in entries:
        chains.setdefault(r.key, []).append(r.chain)
    assert all(sorted(c) == list(range(len(c))) for c in chains.values())
    assert max(map(len, chains.values())) > 1 or bits == 63


def test_a_directory_doubles_until_buckets_fit(docs):
    deep = exact_dedup.build(docs, 1).directory
    assert deep.selectExpr("max(depth)").first()[0] > deep.selectExpr("min(depth)").first()[0]


def test_nothing_in_no_python(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.build(none).directory.count() == 0
    with pytest.raises(ValueError):
        exact_dedup.build(none, 0)
    plan = exact_dedup.dedup(none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
