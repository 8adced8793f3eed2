"""Signatures go out as packed ranges, a row each, whose number follows the size of the input."""

import numpy as np
import pytest

from lodestone.llm import ngram_join as J


def expected(keys, ids):
    """Components of ids that share a key."""
    low = {}
    root = {i: i for i in set(ids)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in zip(keys, ids, strict=True):
        a, b = find(low.setdefault(k, i)), find(i)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_a_flush_is_one_row_a_range(parts):
    r = np.random.default_rng(parts)
    keys, ids = r.integers(0, 1 << 64, 300, dtype=np.uint64)[r.integers(0, 300, 2_000)], r.integers(0, 900, 2_000)
    sent = [J._signed(keys[a : a + 500], ids[a : a + 500], parts).to_pylist() for a in range(0, 2_000, 500)]
    assert all(len(rows) == len({x["part"] for x in rows}) <= parts for rows in sent)
    flat = [(x["part"], k, i) for rows in sent for x in rows for k, i in zip(np.frombuffer(x["keys"], np.uint64).tolist(), np.frombuffer(x["ids"], np.int64).tolist(), strict=True)]
    assert all(part == ((k >> 32) * parts) >> 32 for part, k, _ in flat)
    assert expected(*zip(*((k, i) for _, k, i in flat), strict=True)) == expected(keys.tolist(), ids.tolist())


def test_ranges_find_the_same_links(spark, monkeypatch):
    words = [f"w{n}" for n in range(60)]
    texts = [" ".join(words[s : s + 30]) for s in (0, 0, 1, 25, 26, 30)] + ["", None]
    docs = spark.createDataFrame([(n + 10, t) for n, t in enumerate(texts)], "doc_id long, text string")
    found = lambda: {(r.doc_id, r.component_id) for r in J.join(docs, 5, 80).collect()}
    few = found()
    monkeypatch.setattr(J, "PART", 3)
    assert found() == few == {(10, 10), (11, 10), (12, 10), (13, 13), (14, 13), (15, 15), (16, 16), (17, 17)}
