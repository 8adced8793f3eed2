"""Ranked lexical search against brute force: every document scored for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import lexical_search
from lodestone.llm.textops import runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, m int, rank string, item_id string", "item_id long, text string, doc_id string, score int"


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def naive(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    lens = [sum(c.values()) for _, c in held]
    big_n, big_l = sum(n > 0 for n in lens), sum(lens)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for (d, c), n in zip(held, lens, strict=True):
            if not n:
                continue
            m = 75 + (25 * n * big_n) // big_l
            s = sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if c[t])
            if s > 0:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "ñandú", "Straße", "日本"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i * 3 - 50, say(rnd.choice([1, 3, 8, 8, 8, 40, 200]))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(40)] + [(2000, None), (2001, ""), (2002, "?! ..."), (2003, "only " * 9000), (2004, say(5000))]
    docs += [docs[7], docs[7], (None, "w1 w2")]
    items = [(i, say(rnd.randint(1, 30))) for i in range(25)] + [(100, "W1, w2-w3; w1"), (101, None), (102, ""), (103, "nobody says this"), (104, "only"), (3, "w5 É"), (None, "w1"), (105, say(900))]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus()
    return spark.createDataFrame([(d, t, 1, "r", "i") for d, t in docs], DOCS).repartition(4), spark.createDataFrame([(i, t, "d", 1) for i, t in items], ITEMS)


@pytest.mark.parametrize(("top", "block", "group", "exact"), [(20, 4096, 1 << 22, 1 << 33), (3, 7, 300, 1 << 33), (1, 1, 1 << 22, 0)])
def test_ranks(tables, monkeypatch, top, block, group, exact):
    for name, value in (("BLOCK", block), ("GROUP_BYTES", group)):
        monkeypatch.setattr(lexical_search, name, value)
    monkeypatch.setattr(lexical_search, "EXACT", exact)
    assert sorted(map(tuple, lexical_search.search(*tables, top).collect())) == naive(*corpus(), top)


def test_nothing(spark, tables):
    docs, items = tables
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


def test_equal_hashes(monkeypatch):
    """Terms are told apart by bytes where all hashes are one."""
    monkeypatch.setattr(lexical_search, "span_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    words, text = lexical_search.Vocabulary([b"ab", b"b", b"abc", b"abd", b"x"]), np.frombuffer(b"abd b abx x ab a abc", np.uint8)
    found = words.find(text, *runs(lexical_search.LETTER[text], np.array([0, len(text)])))
    assert [words.terms[i] if i >= 0 else None for i in found] == [b"abd", b"b", None, b"x", b"ab", None, b"abc"]


def test_strata_and_bounds(tables):
    """A block holds one m, runs in order of term and tf, and no document above its bound."""
    docs, items = corpus()
    words = lexical_search.Vocabulary([t.encode() for _, text in items for t in terms(text)])
    blocks = lexical_search.index(lexical_search.tallies(tables[0], words), 340, 20_000).collect()
    number = {t: i for i, t in enumerate(words.terms)}
    wanted = Counter(number[t.encode()] for t in terms(items[0][1]))
    asked = lexical_search.Items(np.array([0]), np.array([0, len(wanted)]), np.array(list(wanted)), np.array(list(wanted.values())), len(words.terms))
    for row in map(lambda r: r.asDict(), blocks):
        term, tf, many = (np.frombuffer(row[c], np.int32) for c in ("term", "tf", "many"))
        assert (np.diff(term) >= 0).all() and (np.diff(tf)[np.diff(term) == 0] < 0).all() and many.sum() == len(row["place"]) // 2
        best = lexical_search.Block(row, len(words.terms)).best(asked.terms, asked.worth, 0, 20)[1]
        assert not len(best) or best[0] <= asked.bounds(row)[0]
    assert len({r.m for r in blocks}) > 5
