"""The training-data operators against brute force, on small fixtures with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bin_packing, bpe_trie, hamming_search, language_kernel, lz_dedup, ngram_join, quality_rules, quality_trees, shared, token_counts, toxicity_cnn
from lodestone.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept_text int, score string"


def corpus():
    """Copies, near copies, shared passages, ties, nulls, empty and long texts, clashing extra columns."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, passage = say(300), say(60)
    texts = [" ".join(base)] * 3
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rnd.randrange(300)] = "changed"
        texts.append("\t".join(near))
    texts += [" ".join(say(rnd.randint(1, 200)) + passage + say(rnd.randint(0, 200))) for _ in range(15)]
    texts += [None, "", "  \n\t ", "one", "one two", "One TWO", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m n", "x " * 5000, "x" * 3000, " ".join(passage * 3), "🙂 — ¿qué? \u0085 z", "<|endoftext|>don't 's\n\n  we'll<|endoftext|>"]
    texts += [" ".join(say(30_000))]
    ids = random.Random(1).sample(range(-20, 200), len(texts))
    rows = [(i, t, "en", "s", 0, "clash", 1, "clash") for i, t in zip(ids, texts, strict=True)]
    return [*rows, rows[3], (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in corpus() if r[0] is not None}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_removed_passages(docs, texts, nothing):
    low, words = {}, {d: WORD.findall(t) for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            low.setdefault(tuple(words[d][i : i + 13]), d)
    got = {r.doc_id: r for r in lz_dedup.remove(docs, 13).collect()}
    assert set(got) == set(texts)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if low[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        assert got[d].kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed) == (len(w), len(gone))
    assert lz_dedup.remove(docs, 13).count() == len(texts) + 1  # a repeated row stays repeated
    assert lz_dedup.remove(nothing, 13).count() == 0


def test_words_decide_where_anchors_agree(spark):
    """Two windows with one anchor, whose hashes agree in 40 bits: five shared words are no copy."""
    one = "w3829 w3406 w1877 w2793 w1158 w856 w1607 w3087 w584 w1372 w3932 w60 w3864"
    two = "w1640 w809 w974 w1201 w1158 w856 w1607 w3087 w584 w3585 w3516 w2398 w2493"
    docs = spark.createDataFrame([(1, one)], "doc_id long, text string").union(spark.createDataFrame([(2, two)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in lz_dedup.remove(docs, 13).collect()) == [(1, 0, one), (2, 0, two)]


@pytest.mark.parametrize(("bits", "disputed"), [(12, 1 << 20), (4, 0)])
def test_words_decide_where_hashes_agree(docs, texts, monkeypatch, bits, disputed):
    monkeypatch.setattr(lz_dedup, "DISPUTED", disputed)  # 0: disputed keys are joined, not broadcast
    low, words = {}, {d: WORD.findall(t) for d, t in texts.items() if len(t) < 100_000}
    for d in sorted(words):
        for i in range(len(words[d]) - 4):
            low.setdefault(tuple(words[d][i : i + 5]), d)
    some = docs.where("text is null or length(text) < 100000")
    got = {r.doc_id: r for r in lz_dedup.remove(some.repartition(3), 5, bits=bits).collect()}
    assert set(got) == set(words)
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - 4) if low[tuple(w[i : i + 5])] < d for j in range(5)}
        assert got[d].kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)


def naive_factors(words, size):
    """Greedy parse of each document against those with smaller ids, one window after another."""
    first, out = {}, []
    for d in sorted(words):
        i, w = 0, words[d]
        while i <= len(w) - size:
            if (at := first.get(tuple(w[i : i + size]))) is None:
                i += 1
                continue
            n, ref = 0, words[at[0]]
            while i + n + size <= len(w) and w[i + n : i + n + size] == ref[at[1] + n : at[1] + n + size]:
                n += 1
            out.append((d, i, n, *at))
            i += n
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    return sorted(out)


@pytest.mark.parametrize("size", [3, 13])
def test_factors(docs, texts, size):
    words = {d: WORD.findall(t) for d, t in texts.items()}
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = [tuple(r) for r in lz_dedup.factors(once.coalesce(1), size).collect()]
    assert sorted(got) == naive_factors(words, size)  # one block holds all
    got = lz_dedup.factors(once.repartition(7), size).collect()  # many blocks
    for r in got:
        assert r.ref_id < r.doc_id and words[r.doc_id][r.start : r.start + r.n + size - 1] == words[r.ref_id][r.ref_start : r.ref_start + r.n + size - 1]


@pytest.mark.parametrize(("size", "hot"), [(13, 1), (1, 8), (2, 1), (5, 8), (70, 8)])
def test_windows_of_any_size(docs, texts, monkeypatch, size, hot):
    monkeypatch.setattr(lz_dedup, "HOT", hot)  # 1: every anchor is split by its windows
    low, words = {}, {d: WORD.findall(t) for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            low.setdefault(tuple(words[d][i : i + size]), d)
    got = {r.doc_id: r for r in lz_dedup.remove(docs.repartition(5), size).collect()}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - size + 1) if low[tuple(w[i : i + size])] < d for j in range(size)}
        assert got[d].kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)
    with pytest.raises(ValueError):
        lz_dedup.factors(docs, 0)


def brute_join(texts, size, percent):
    sets, root = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("size", "percent", "block", "sketches"), [(3, 90, None, None), (5, 80, None, None), (5, 80, 500, 4)])
def test_join(docs, texts, nothing, monkeypatch, size, percent, block, sketches):
    if block:  # bundles are split and compared in blocks
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "SPLIT", block)
        monkeypatch.setattr(ngram_join, "SKETCHES", sketches)
        monkeypatch.setattr(shared, "MOST_OF_KEY", 1)  # and every key is dealt over many tasks
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, size, percent).collect()}
    assert got == brute_join(texts, size, percent)
    if not block:
        assert ngram_join.join(nothing, size, percent).count() == 0


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "MOST_OF_KEY", most)  # 1: every join deals the edges of a node over many tasks
    rnd = random.Random(8)
    edges = [(0, k) for k in range(1, 60)] + [(500, k) for k in range(100, 140)] + [(k, k + 1) for k in range(200, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7), (-5, 300)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if x != 7 or r != 7}
    got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rnd = random.Random(percent)
    common = np.zeros(1 << ngram_join.COMMON, bool)
    common[rnd.sample(range(1 << ngram_join.COMMON), 1 << 20)] = True
    for _ in range(300):
        n = rnd.choice([1, 2, 3, 5, 8, 9, 10, 12, 17, 20, 30, 60, 200, 900])
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            if rnd.random() < 0.5 and c:
                c.remove(rnd.choice(sorted(c)))
            if rnd.random() < 0.6:
                c.add(rnd.getrandbits(64))
            if not c or 100 * len(a & c) < percent * len(a | c):
                break
            b = c
        packed = [np.array(sorted(s), np.uint64) for s in (a, b)]
        for flags in (None, common):
            keys, owner = ngram_join.signatures(np.concatenate(packed), np.array([0, len(a), len(a) + len(b)]), percent, flags)
            assert a == b or set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_forgets_words(monkeypatch):
    monkeypatch.setattr(bpe_trie, "CACHE", 16)
    with open(tokenizer_path(), encoding="utf-8") as file:
        bpe = bpe_trie.Bpe(file.read())
    rnd, tk = random.Random(3), library()
    for n in (5, 12, 300, 4, 900, 1):
        text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(n))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, offsets = bpe.encode(lz_dedup.Slice(np.array([1]), raw, np.array([0, len(raw)])))
        assert ids.tolist() == tk.encode(text, add_special_tokens=False).ids and offsets.tolist() == [0, len(ids)]


def test_bpe(docs, texts, nothing):
    rnd = random.Random(2)
    odd = {1000 + k: "".join(rnd.choice("ab sthe'  \n\t.,!12é日'lrvmd<|>") for _ in range(rnd.randint(0, 50))) for k in range(300)}
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(odd.items()), "doc_id long, text string"))
    got, tk = {r.doc_id: r for r in bpe_trie.encode(more, tokenizer_path()).collect()}, library()
    for d, t in (texts | odd).items():
        ids = tk.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[d].ids, "<u4").tolist() == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded == tk.decode(ids, skip_special_tokens=False)
    assert bpe_trie.encode(nothing, tokenizer_path()).count() == 0


def test_packing(docs, texts, nothing):
    rows, tk, want = bin_packing.pack_documents(docs, tokenizer_path()).collect(), library(), {}
    for d, t in texts.items():
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[d, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert bin_packing.pack_documents(nothing, tokenizer_path()).count() == 0


def test_bin_completion_beats_best_fit():
    lengths = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # best fit decreasing leaves gaps where two exact fillings exist
    best = bin_packing.pack(lengths, 10)
    assert sum(best.values()) == 4 and sum(sum(p) * n for p, n in best.items()) == 40
    rnd = random.Random(5)
    for _ in range(40):
        lengths = {}
        for _ in range(rnd.randint(1, 40)):
            x = rnd.randint(1, 30)
            lengths[x] = lengths.get(x, 0) + 1
        best, got = bin_packing.pack(lengths, 30), {}
        for p, n in best.items():
            assert sum(p) <= 30
            for x in p:
                got[x] = got.get(x, 0) + n
        assert got == lengths and sum(best.values()) <= sum(bin_packing.best_fit(lengths, 30).values())


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[700:720] = x[700]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(5000, None, ""), (5001, [0.0] * 16, ""), (5002, [1.0, None] + [1.0] * 14, ""), (5003, [float("nan")] + [1.0] * 15, ""), (5004, [1.0], ""), (None, [1.0] * 16, "")]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = {}
    for r in hamming_search.search(data, data.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:20]
        hit += len(set(want.tolist()) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(score - x[q] @ x[v]) < 1e-9 for _, v, score in found)
    assert hit / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in got[700]][:19] == list(range(701, 720))
    few = data.where("vec_id < 5")
    assert hamming_search.search(few, few, 20).count() == 5 * 4
    assert hamming_search.search(data.where("false"), data.where("false"), 20).count() == 0


def test_radius_finds_every_code():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (400, hamming_search.BITS // 8), dtype=np.uint8)
    codes[1:9] = codes[0]
    codes[1:9, 0] ^= np.uint8(1) << np.arange(8, dtype=np.uint8)
    near, index = hamming_search.distances(codes[:50], codes), hamming_search.Index(codes)
    for radius in (0, 1, 3, 17, 25, 30, 64, hamming_search.BITS):
        assert sum(t + 1 for t in hamming_search.limits(radius)) == radius + 1
        for q in range(50):
            found = set(index.found(codes[q], radius).tolist())
            assert set(np.flatnonzero(near[q] <= radius).tolist()) <= found
            assert set(index.within(codes[q], radius, 1).tolist()) == set(np.flatnonzero(near[q] <= radius).tolist())
    assert len(index.found(codes[20], 3)) < 40  # the index keeps others out
    assert len(index.within(codes[20], 0, 400)) == 400  # the radius grows until enough are found


def rules_by_hand(text):
    words, lines, seen = WORD.findall(text), text.split("\n"), set()
    dup = 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows, where = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            for i in at:
                where.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(where)


def test_rules(spark, docs, texts, nothing):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    more = spark.createDataFrame([(900, "a b\na b\n\n\nc d\r\na b \na b"), (901, "x y z x y z x y"), (902, "# ok #")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs.select("doc_id", "text").unionByName(more), labels).collect()}
    for d, t in (texts | {r.doc_id: r.text for r in more.collect()}).items():
        r = got[d]
        n = rules_by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing, labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).where("kept = base_failed").count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """One of the given tables, for held-out accuracy."""
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held_out(rows, of, left):
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % of == left]


def test_quality(labelled, docs, nothing):
    data, labels = labelled
    out = held_out(quality_trees.classify(data, labels).join(labels, "doc_id").collect(), 3, 1)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    odd = quality_trees.classify(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == len(corpus()) - 1
    assert quality_trees.classify(nothing, labels).count() == 0
    assert {r.score for r in quality_trees.classify(docs, labels.where("false")).collect()} == {0.5}


def test_toxicity(labelled, docs, nothing):
    data, labels = labelled
    rows = toxicity_cnn.classify(data, labels).join(labels, "doc_id").collect()
    out = held_out(rows, 5, 0)
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.9
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03
    odd = toxicity_cnn.classify(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == len(corpus()) - 1
    assert toxicity_cnn.classify(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity_cnn.classify(docs, labels.where("false")).collect()} == {0}


def test_language(labelled, docs, nothing):
    data, _ = labelled
    kernel = language_kernel.learn(data)
    out = held_out(language_kernel.identify(data, kernel).join(data.select("doc_id", "lang"), "doc_id").collect(), 4, 2)
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.95
    odd = {r.doc_id: r for r in language_kernel.identify(docs, kernel).collect()}
    for d, t in {r[0]: r[1] for r in corpus() if r[0] is not None}.items():
        assert (odd[d].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert language_kernel.identify(nothing, kernel).count() == 0
    assert {r.lang_pred for r in language_kernel.identify(docs, language_kernel.learn(nothing)).collect()} == {"und"}


def test_token_counts(spark):
    schema = "batch_id long, change_id string, doc_id long, tokenizer string, source string, lang string, old_tokens long, new_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    state = token_counts.Rollup(spark)
    first = batch((1, "a", 1, "t", "s", "en", None, 10), (1, "b", 2, "t", "s", None, None, 5), (1, "b", 2, "t", "s", None, None, 5), (1, "c", 3, "t", None, "en", None, 7), (1, "d", 4, "t", "s", "en", None, None))
    second = batch((2, "a", 1, "t", "s", "en", 10, 12), (2, "c", 3, "t", None, "en", 7, None))
    for changes in (first, second, first, second):
        state.commit(changes)
    assert {(r.source, r.lang, r.n_docs, r.n_tokens) for r in state.totals().collect()} == {("s", "en", 1, 12), ("s", None, 1, 5)}
    empty = token_counts.Rollup(spark)
    empty.commit(batch())
    assert empty.totals().count() == 0


def test_token_counts_of_bpe(spark):
    from lodestone.llm.queries import token_counts_of_bpe

    tk, want, seen = library(), Counter(), set()
    for r in sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id):
        text = r.text or ""
        if text not in seen:  # copies are deleted, what is left loses its symbols
            seen.add(text)
            plain = text.translate({ord(c): None for c in token_counts.SYMBOLS})
            want[r.source, r.lang] += len(tk.encode(plain, add_special_tokens=False).ids)
            want[r.source, r.lang, "n"] += 1
    got = token_counts_of_bpe(spark, DATA).collect()
    assert {(r.source, r.lang): (r.n_tokens, r.n_docs) for r in got} == {k: (want[k], want[(*k, "n")]) for k in want if len(k) == 2}
    assert {r.tokenizer for r in got} == {"byte-bpe-50k"}


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == columns and kept.dtypes == before.dtypes, name
        kept = kept.cache()
        assert 0 < kept.count() <= before.count()
        if name == "near_duplicates":
            want = brute_join({r.doc_id: r.text or "" for r in before.collect()}, 5, 80)
            assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}
    out = corpus_pipeline.packing(spark, kept, DATA)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}


#: Names that helpers, or Spark's own steps, might use.
CLASHING = ["_kept", "_id", "_spans", "n_words", "kept_text", "kept_id", "spans", "spans_of", "salt", "score", "predicted", "near", "component_id", "N_Removed"]


def test_stages_on_odd_rows(spark, texts):
    """Nulls, empty and very long texts, ties and repeated rows through every stage, with extra columns of clashing names."""
    import corpus_pipeline

    odd = spark.createDataFrame([(*r[:5], *(f"{c}-{r[0]}" for c in CLASHING)) for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)
    given = Counter(r[0] for r in corpus() if r[0] is not None)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        rows = out.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING), name
        many = Counter(r.doc_id for r in rows)
        assert all(many[d] == given[d] for d in many), name  # repeated rows stay or go together
        if name == "near_duplicates":
            assert set(many) == {d for d, (_, c) in brute_join(texts, 5, 80).items() if c == d}
        if name == "repeated_passages":
            assert many == given and all(r.text is None or r.n_chars in (0, len(r.text)) for r in rows)
            assert {r.doc_id for r in rows if r.text is None} == {d for d, t, *_ in corpus() if t is None and d is not None}
        assert stage(spark, odd.where("false"), DATA).columns == odd.columns, name
        assert stage(spark, odd.where("false"), DATA).count() == 0, name
    packed = corpus_pipeline.packing(spark, odd, DATA)
    assert {r.doc_id for r in packed.collect()} == set(given)
    assert corpus_pipeline.packing(spark, odd.where("false"), DATA).count() == 0


def folders(spark):
    return {p.name for p in Path(shared.shared_dir(spark).removeprefix("file:")).iterdir()}


def test_run_cleans_up(spark):
    """The pipeline leaves one table, its result, and other jobs' tables alone."""
    import corpus_pipeline

    others = shared.table(spark.range(5), "others")
    before = folders(spark)
    out = corpus_pipeline.run(spark, DATA)
    assert len(folders(spark) - before) == 1 and out.count() > 0 and before <= folders(spark) and others.count() == 5


def test_two_runs_at_once(spark, monkeypatch):
    """Each run removes its own tables, while the other's are being read."""
    from concurrent.futures import ThreadPoolExecutor

    from lodestone.llm import stages

    slow = lambda spark, docs, sf_dir: shared.table(docs.withColumn("n_chars", F.col("n_chars") + 1), "step")
    monkeypatch.setattr(stages, "STAGES", [(f"stage{i}", slow) for i in range(4)])
    before = folders(spark)
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: stages.run(spark, DATA).count(), range(2)))
    assert runs == [200, 200] and len(folders(spark) - before) == 2


def test_a_failed_run_leaves_nothing(spark, monkeypatch):
    from lodestone.llm import stages

    def fails(spark, docs, sf_dir):
        shared.table(docs, "step")
        raise RuntimeError("no")

    monkeypatch.setattr(stages, "STAGES", [("kept", lambda spark, docs, sf_dir: docs), ("fails", fails)])
    before = folders(spark)
    with pytest.raises(RuntimeError):
        stages.run(spark, DATA)
    assert folders(spark) == before


def test_digest_columns(spark):
    from lodestone.llm.queries import op2_lz_dedup, op9_bpe_trie

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op9_bpe_trie(spark, DATA).collect()}
    assert all(rows[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in text.items())
    whole = [r for r in op2_lz_dedup(spark, DATA).where(F.col("n_removed") == 0).collect()]
    assert whole and all(r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text[r.doc_id])).encode()).hexdigest() for r in whole)


def test_packing_near_the_bound():
    assert bin_packing.completions(504, {300: 1, 210: 2, **dict.fromkeys(range(5, 205), 1)}, 6)[1][0] == 210  # not only fillings of the largest
    draw = np.random.default_rng(3)
    lengths = {int(x): int(n) for x, n in zip(draw.choice(np.arange(200, 600), 60, False), draw.integers(1, 400, 60), strict=True)}
    packed, got = bin_packing.pack(lengths), Counter()
    for pattern, n in packed.items():
        assert sum(pattern) <= bin_packing.ROOM
        for x in pattern:
            got[x] += n
    least = bin_packing.relaxed(lengths, bin_packing.ROOM)[1]
    assert got == lengths and least <= sum(packed.values()) <= 1.01 * least < sum(bin_packing.best_fit(lengths, bin_packing.ROOM).values())
