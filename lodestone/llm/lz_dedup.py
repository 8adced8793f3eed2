"""Substring dedup by relative Lempel-Ziv parsing.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, unchanged. A window of ``size`` consecutive words
of a document is a duplicate if the same words also start in a document with a smaller doc_id; every word that
a duplicate window covers goes. Windows are judged on the input.

Parsing: documents are factored, in order of words, against the documents with smaller doc_ids, block by block of reference. The index of a block
knows one place of each window: where it first starts in the smallest document. A factor (document, first window, number of windows, reference document, its
first window) begins at a window that the index finds and runs on greedily as long as the reference goes on with the same words; at its end the next
window is looked up anew, so that those across each factor boundary are checked too, and a factor of one window has ``size`` words, which is long enough to go.

There are two sorts of blocks. A task's block holds the documents that it has read (about FLUSH words at a time). Only windows that are new in it go on, one entry
for each: a window that a third of all documents share sends one entry a flush. The other blocks hold phrases by anchor: each text is cut into phrases at
content-defined places: a phrase holds the windows whose smallest hash of ANCHOR consecutive words (the leftmost, if equal) is the same one, so equal windows of any two
documents lie in phrases with equal anchors, and meet in one block. Anchors that HOT documents of a bounded sample have (a passage that many documents hold, with other
words around it in each) would make one block too large: their windows go by their own hash instead. Which anchors these are changes no result.

Hashes only propose: 64 bits of a window within a task, 40 bits and those of its anchor between tasks. Words decide (``remove``): each factor is compared, word by word, with its reference, whose
words travel in chunks of CHUNK. A window that its factor's words don't bear out, or that differs from another of its document with the same hash, is disputed; every window with a disputed hash is
then grouped by its words over all documents, which settles it. With 64 bits that hardly ever happens; ``bits`` makes it happen in tests.

A document sends its first occurrence of each window; what is found of it holds for its later ones, if their words are the same.

Nulls and edge cases: null and empty texts have no words and lose none; texts shorter than a window lose none; equal
windows within one document alone are not duplicates; rows with a null doc_id take no part; rows that share a
doc_id count as one document, whose spans apply by word position to each row. Extra columns stay, but columns of docs that
have an output's name give way to it; ``names`` gives the outputs other names. Windows of any size from one word on. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import Slice, fresh, joined, lookup, map_slices, partitions, spread, table
from lodestone.llm.textops import Words, in_doc, mix, shingles

ANCHOR, FLUSH, SAMPLE, HOT, PHRASE, CHUNK, DISPUTED = 5, 1 << 20, 1 << 12, 8, 48, 32, 1 << 20


def _smallest(g: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost smallest value among g[i : i + n], for each i."""
    at, size = np.arange(len(g), dtype=np.int64), 1
    while size < n:
        step = min(size, n - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        size += step
    return at


def _keys(words: Words, size: int, bits: int = 64) -> np.ndarray:
    """Hashes of all windows of ``size`` words, to ``bits`` bits."""
    return shingles(words.hashes, size) & np.uint64(2**bits - 1)


def windows(part: Slice, size: int, hot: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Of each window: document (place in the slice), first word (within the document), hash, anchor's hash, and
    the phrase, numbered; a phrase has at most PHRASE windows. Windows with an anchor among ``hot`` (sorted) are phrases and anchors of their own."""
    words = Words(part.buf, part.offsets)
    anchor = min(ANCHOR, size)
    n = max(0, len(words.hashes) - size + 1)
    at = np.flatnonzero(in_doc(words, size))
    if not len(at):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    g = shingles(words.hashes, anchor)
    place = _smallest(g, size - anchor + 1)[:n][at]
    doc, key, of = words.doc()[at], _keys(words, size, bits)[at], g[place]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    if hot is not None and len(hot):
        common = hot[np.minimum(np.searchsorted(hot, of), len(hot) - 1)] == of
        of = np.where(common, mix(of + mix(key)), of)
        new |= common
        new[1:] |= common[:-1]
    every = np.arange(len(at))
    new |= (every - np.maximum.accumulate(np.where(new, every, 0))) % PHRASE == 0
    return doc, at - words.offsets[doc], key, of, np.cumsum(new) - 1


def hot_anchors(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the anchors that HOT or more of SAMPLE documents (the smallest hashes of doc_id) have."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most SAMPLE numbers

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            doc, _, _, anchor, _ = windows(part, size)
            pairs = np.unique(np.column_stack([doc.astype(np.uint64), anchor]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64))], ["anchor"])

        return each

    found = map_slices(texts, make, "anchor long").groupBy("anchor").count().where(F.col("count") >= HOT).select("anchor").toArrow()  # anchors of the sample alone
    return np.sort(found["anchor"].to_numpy().view(np.uint64))


def _narrow(x: np.ndarray) -> np.ndarray:
    """As bytes of the smallest of 1, 2, 4 or 8 bytes a number that fits."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if k is np.int64 or (x.min(initial=0) >= 0 and x.max(initial=0) <= np.iinfo(k).max))
    return x.astype(kind)


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n]).astype(np.int64)


def _chained(doc: np.ndarray, start: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Factors (document, first window, number of windows, reference document, its first window) of found windows, in text order: runs whose places in
    the reference follow on."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return np.column_stack([doc[first], start[first], np.diff(np.append(first, len(doc))), ref[first], at[first]]).astype(np.int64)


def _index(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window (those of a document in text order): the entry that the index of the block keeps for it, the first in the smallest document;
    and whether it is the document's first."""
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(key[order], kind="stable")]
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    own = np.ones(len(k), bool)
    own[1:] = new[1:] | (d[1:] != d[:-1])
    entry, first = np.empty(len(k), np.int64), np.empty(len(k), bool)
    entry[order], first[order] = order[new][np.cumsum(new) - 1] if len(k) else order, own
    return entry, first


def parse(doc: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors a block of whole texts (windows one after another, each document's in text order) against itself: (factors, the places of the
    windows that are new in it and a document's first)."""
    entry, first = _index(key, doc)
    found = np.flatnonzero(doc[entry] != doc)
    goes_on = lambda a, b: (doc[a] == doc[b]) & (start[a] + 1 == start[b]) & (a + 1 == b)
    heads = np.ones(len(found), bool)  # where the index's places don't follow on
    heads[1:] = ~(goes_on(found[:-1], found[1:]) & goes_on(entry[found[:-1]], entry[found[1:]]))
    edges = np.append(np.flatnonzero(heads), len(found))
    places = np.arange(len(doc))
    last = np.append(np.flatnonzero(~goes_on(places[:-1], places[1:])), len(doc) - 1)  # the last window of each text
    last = last[np.searchsorted(last, places)] if len(doc) else places
    out, done = [], 0
    for a, b in zip(found[edges[:-1]].tolist(), found[edges[1:] - 1].tolist(), strict=True):
        a = max(a, done)
        while a <= b:  # a factor: at least to the run's end, or on as long as the reference has the same windows
            at, n = int(entry[a]), b - a + 1
            most = min(last[a] - a, last[at] - at) + 1
            while n < most:
                step = min(64, most - n)
                same = key[a + n : a + n + step] == key[at + n : at + n + step]
                if not same.all():
                    n += int(same.argmin())
                    break
                n += step
            out.append((doc[a], start[a], n, doc[at], start[at]))
            a = done = a + n
    new = np.flatnonzero(first & (doc[entry] == doc))
    return np.array(out, np.int64).reshape(-1, 5), new


def clashes(part: Slice, doc: np.ndarray, start: np.ndarray, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and keys of windows whose words differ from those of an earlier one of the document with the same key."""
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    again = np.zeros(len(order), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    later = np.flatnonzero(again)
    if not len(later):
        return doc[:0], key[:0]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))[later]
    numbers: dict[bytes, int] = {}
    base, words = np.zeros(len(part), np.int64), []
    for d in np.unique(doc[order][later]).tolist():
        base[d] = len(words)
        words += [numbers.setdefault(w, len(numbers)) for w in part.text(d).split()]
    ids, d = np.array(words, np.int64), doc[order][later]
    a, b = base[d] + start[order][head], base[d] + start[order][later]
    apart = np.zeros(len(later), bool)
    for j in range(size):
        apart |= ids[a + j] != ids[b + j]
    return d[apart], key[order][later][apart]


def _sent(doc: np.ndarray, start: np.ndarray, key: np.ndarray, anchor: np.ndarray, phrase: np.ndarray, clash: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Factors a task's block and packs what it must ask other blocks: the new windows, by phrase; the factors that it has found, and its clashes."""
    spans, new = parse(doc, start, key)
    spans = np.concatenate([spans, clash])
    names = ["bucket", "anchor", "doc", "start", "mask", "window", "spans"]
    batches = []
    if len(spans):
        bucket = (mix(spans[:, 0].astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % n_buckets
        own = spread(np.argsort(bucket, kind="stable"), bucket, {"spans": np.ascontiguousarray(spans).view("V40").ravel()}, n_buckets)
        batches.append(pa.RecordBatch.from_arrays([own["bucket"], *[pa.nulls(own.num_rows, pa.binary())] * 5, own["spans"]], names))
    doc, start, key, anchor, phrase = (x[new] for x in (doc, start, key, anchor, phrase))
    head = np.flatnonzero(np.diff(phrase, prepend=-1))  # of each phrase its first window that is sent
    own = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(phrase))))
    mask = np.bincount(own, 2.0 ** (start - start[head][own]), len(head)).astype(np.int64)
    bucket = (mix(anchor[head]) >> np.uint64(33)).astype(np.int64) % n_buckets
    order = np.lexsort((start[head], doc[head], bucket))
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    window_order = np.lexsort((start, doc, bucket[own]))
    window_edges = np.searchsorted(bucket[own][window_order], np.arange(n_buckets + 1))
    low = (key & np.uint64(0xFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[window_order, :5]
    columns: list[list] = [[] for _ in names]
    for b in np.flatnonzero(np.diff(edges)):
        h = head[order[edges[b] : edges[b + 1]]]
        row = (b, anchor[h].tobytes(), _narrow(np.diff(doc[h], prepend=0)[1:]).tobytes(), _narrow(start[h]).tobytes(), _narrow(mask[order[edges[b] : edges[b + 1]]]).tobytes(), low[window_edges[b] : window_edges[b + 1]].tobytes(), None)
        for c, x in zip(columns, row, strict=True):
            c.append(x)
        columns[2][-1] = doc[h[:1]].astype(np.int64).tobytes() + columns[2][-1]
    batches.append(pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names))
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(b.num_rows for b in batches) else batches[0]


def _factor(rows: pa.Table) -> pa.Table:
    """Factors the phrases of blocks against each other."""
    doc, start, mask, anchor, low = [], [], [], [], []
    for r in rows.select(["anchor", "doc", "start", "mask", "window"]).to_pylist():
        if r["anchor"] is not None:
            a = np.frombuffer(r["anchor"], np.uint64)
            d = np.frombuffer(r["doc"][:8], np.int64)
            doc.append(d if len(a) == 1 else np.cumsum(np.concatenate([d, _wide(r["doc"][8:], len(a) - 1)])))
            start.append(_wide(r["start"], len(a)))
            mask.append(_wide(r["mask"], len(a)))
            anchor.append(a)
            low.append(np.frombuffer(r["window"], np.uint8).reshape(-1, 5))
    spans = [joined(rows["spans"], np.int64).reshape(-1, 5)]
    if doc:
        doc, start, mask, anchor, low = (np.concatenate(x) for x in (doc, start, mask, anchor, low))
        bits = (mask[:, None] >> np.arange(int(mask.max()).bit_length())) & 1 > 0
        phrase, offset = np.nonzero(bits)
        _, back, many = np.unique(anchor, return_inverse=True, return_counts=True)
        shared = many[back][phrase] > 1
        phrase, offset, low = phrase[shared], offset[shared], low[shared]
        own = np.zeros((len(low), 8), np.uint8)
        own[:, :5] = low
        doc, start = doc[phrase], start[phrase] + offset
        entry, first = _index(mix(anchor[phrase] + mix(own.view(np.uint64).ravel())), doc)
        found = np.flatnonzero(first & (doc[entry] != doc))
        found = found[np.lexsort((start[found], doc[found]))]
        spans.append(_chained(doc[found], start[found], doc[entry[found]], start[entry[found]]))
    spans = np.concatenate(spans)
    return pa.table({"doc_id": spans[:, 0], "start": spans[:, 1].astype(np.int32), "n": spans[:, 2].astype(np.int32), "ref_id": spans[:, 3], "ref_start": spans[:, 4].astype(np.int32)})


def _found(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Factors by their hashes; rows without windows (n = 0) hold a clashing key as ref_id."""
    if size < 1 or not 1 <= bits <= 64:
        raise ValueError("a window has at least one word, and a hash 1 to 64 bits")
    n_buckets = 4 * partitions(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, size))  # anchors of a bounded sample

    def make():
        held: list[tuple[np.ndarray, ...]] = []
        clash: list[np.ndarray] = [np.zeros((0, 5), np.int64)]

        def each(part: Slice | None) -> pa.RecordBatch | None:
            if part is not None:
                doc, start, key, anchor, phrase = windows(part, size, hot.value, bits)
                if len(doc):
                    d, k = clashes(part, doc, start, key, size)
                    zero = np.zeros(len(d), np.int64)
                    clash.append(np.column_stack([part.ids[d], zero, zero, k.view(np.int64), zero]))
                    held.append((part.ids[doc], start, key, anchor, phrase + (held[-1][4][-1] + 1 if held else 0)))
                if sum(len(h[0]) for h in held) < FLUSH:
                    return None
            if not held:
                return None
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            apart = np.unique(np.concatenate(clash), axis=0)
            held.clear()
            clash[1:] = []
            return _sent(*columns, apart, n_buckets)

        return each

    sent = map_slices(docs, make, "bucket int, anchor binary, doc binary, start binary, mask binary, window binary, spans binary", tail=True)
    return sent.groupBy("bucket").applyInArrow(_factor, "doc_id long, start int, n int, ref_id long, ref_start int")


def factors(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, start, n, ref_id, ref_start: from word ``start`` on, n consecutive windows (n + size - 1 words) have the hashes of those in document ref_id from
    its word ``ref_start`` on."""
    return _found(docs, size, 64).where("n > 0")


def _claims(rows: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """claim_of (a doc_id) and its claims (start, n, ref_id, ref_start, chunk, words): from word ``start`` on it has the n windows that begin at word ``ref_start`` of document ref_id, whose
    words stand in chunks. A chunk is asked for once, however many factors lie on it. All columns of rows are read, so that this and the comparison share one shuffle of them."""
    chunks = F.sequence(F.floor(F.col("ref_start") / CHUNK), F.floor((F.col("ref_start") + F.col("n") + (size - 2)) / CHUNK))
    pieces = found.where("n > 0").select("*", F.explode(chunks).alias("chunk"))
    wanted = table(pieces.groupBy("ref_id", "chunk").agg(F.count("*").alias("many")), "wanted")
    most = wanted.agg(F.coalesce(F.max("many"), F.lit(0))).first()[0]
    of, some = fresh(rows, "asked_of"), fresh(rows, "asked")
    asked = wanted.groupBy(F.col("ref_id").alias(of)).agg(F.collect_list(F.col("chunk").cast("long")).alias(some))  # at most the chunks of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, wished in zip(batch.column(of).to_pylist(), batch.column("text").cast(pa.binary()), batch.column(some).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                wished = [c for c in wished if c * CHUNK < len(words)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(wished), pa.int64()), pa.array(wished, pa.int64()), pa.array([b" ".join(words[c * CHUNK : (c + 1) * CHUNK]) for c in wished], pa.binary())], ["ref_id", "chunk", "words"])

    held = rows.join(asked.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(of)).select(*rows.columns, of, some).mapInArrow(run, "ref_id long, chunk long, words binary")
    one = held.groupBy("ref_id", "chunk").agg(F.min("words").alias("words"))  # rows may share a doc_id
    piece = F.struct("ref_id", "ref_start", "start", "n", "chunk", "words")
    return lookup(pieces, one, ["ref_id", "chunk"], "doc_id", most).groupBy(F.col("doc_id").alias("claim_of")).agg(F.collect_list(piece).alias("claims"))


def _settled(docs: DataFrame, keys: DataFrame, size: int, bits: int) -> DataFrame:
    """claim_of and claims as above, for every window with one of the keys that a smaller doc_id has, compared by words over all documents."""
    known = keys.count() <= DISPUTED
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow()["key"].to_numpy())) if known else None

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            doc, start, key, _, _ = windows(part, size, None, bits)
            key = key.view(np.int64)
            some = np.flatnonzero(np.isin(key, wanted.value)) if known else np.arange(len(key))
            words, of = [], -1
            texts: list[bytes] = []
            for d, at in zip(doc[some].tolist(), start[some].tolist(), strict=True):
                texts, of = (texts, of) if d == of else (part.text(d).split(), d)
                words.append(b" ".join(texts[at : at + size]))
            return pa.RecordBatch.from_arrays([pa.array(part.ids[doc[some]]), pa.array(start[some]), pa.array(key[some]), pa.array(words, pa.binary())], ["doc_id", "start", "key", "words"])

        return each

    seen = map_slices(docs, make, "doc_id long, start long, key long, words binary")
    seen = table(seen if known else seen.join(keys, "key", "left_semi"), "disputed")
    lows = table(seen.groupBy("words").agg(F.min("doc_id").alias("low"), F.count("*").alias("many")), "lows")
    most = lows.agg(F.coalesce(F.max("many"), F.lit(0))).first()[0]
    later = lookup(seen, lows.select("words", "low"), ["words"], "doc_id", most).where(F.col("doc_id") > F.col("low"))
    zero = F.lit(0)
    piece = F.struct(F.col("low").alias("ref_id"), zero.alias("ref_start"), F.col("start").cast("int").alias("start"), F.lit(1).alias("n"), zero.cast("long").alias("chunk"), "words")
    return later.groupBy(F.col("doc_id").alias("claim_of")).agg(F.collect_list(piece).alias("claims"))


def _kept(text: bytes, claims: list[dict], size: int, bits: int) -> tuple[bytes, int, int, list[int]]:
    """(kept words joined by one space, words, words removed, keys of claimed windows that the words don't bear out) of one text."""
    words = text.split()
    if not claims or len(words) < size:
        return b" ".join(words), len(words), 0, []
    factors: dict[tuple[int, int, int, int], dict[int, list[bytes]]] = {}
    for c in claims:
        factors.setdefault((c["start"], c["n"], c["ref_id"], c["ref_start"]), {})[c["chunk"]] = c["words"].split(b" ")
    keys = _keys(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])), size, bits)
    hit, claimed = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for (start, n, _, ref_start), chunks in factors.items():
        first = min(chunks)
        theirs = [w for c in range(first, first + len(chunks)) for w in chunks.get(c, ())][ref_start - first * CHUNK :][: n + size - 1]
        mine = words[start : start + n + size - 1]
        claimed[start : start + n] = True
        if mine == theirs:
            hit[start : start + n] = True
        else:
            same = np.zeros(n + size - 1, np.int64)
            same[: min(len(mine), len(theirs))] = [a == b for a, b in zip(mine, theirs, strict=False)]
            whole = np.convolve(same, np.ones(size, np.int64), "valid") == size
            hit[start : start + n] |= whole[: max(0, len(hit) - start)]
    first_of = {int(keys[i]): i for i in np.flatnonzero(hit)[::-1].tolist()}
    for i in np.flatnonzero(np.isin(keys, keys[hit]) & ~hit).tolist():  # later occurrences of what is found
        j = first_of[int(keys[i])]
        hit[i] = words[i : i + size] == words[j : j + size]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-1][: len(hit)] += hit
    edge[size : size + len(hit)] -= hit
    covered = np.cumsum(edge[:-1]) > 0
    return b" ".join(compress(words, (~covered).tolist())), len(words), int(covered.sum()), np.unique(keys[claimed & ~hit]).view(np.int64).tolist()


def remove(docs: DataFrame, size: int = 13, names: tuple[str, str, str] = ("kept_text", "n_words", "n_removed"), bits: int = 64) -> DataFrame:
    """The columns of docs and kept_text (the kept words joined by one space), n_words, n_removed, or what ``names`` calls these.

    The claims of a document, with the words of its references, are gathered to one row and compared with its text. ``bits``: of the windows' hashes; fewer make more disputes."""
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    rows = docs.select(*own).where("doc_id is not null")
    key, found_in = fresh(rows, "claim_of"), fresh(rows, "claims")
    disputed_in = fresh(rows.select("*", *(F.lit(0).alias(n) for n in names)), "disputed")
    found = table(_found(docs, size, bits), "factors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = [_kept(t or b"", c or [], size, bits) for t, c in zip((x.as_py() for x in texts), (x.as_py() for x in batch.column(found_in)), strict=True)]
            text, words, removed, keys = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(text, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], [*own, *names, disputed_in])

    schema = T.StructType([*(docs.schema[c] for c in own), *(T.StructField(c, k) for c, k in zip((*names, disputed_in), (T.StringType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType())), strict=True))])

    def compared(claims: DataFrame) -> DataFrame:
        claims = claims.select(F.col("claim_of").alias(key), F.col("claims").alias(found_in)).hint("shuffle_hash")
        return rows.join(claims, F.col("doc_id").cast("long") == F.col(key), "left").select(*own, found_in).mapInArrow(run, schema)

    claims = _claims(rows, found, size)
    out = table(compared(claims), "compared")
    keys = out.select(F.explode(disputed_in).alias("key")).unionByName(found.where("n = 0").select(F.col("ref_id").alias("key"))).distinct()
    keys = table(keys, "keys")
    if not keys.isEmpty():
        settled = _settled(docs, keys, size, bits).withColumnRenamed("claims", "more")
        every = claims.join(settled, "claim_of", "full").select("claim_of", F.concat(F.coalesce("claims", F.array()), F.coalesce("more", F.array())).alias("claims"))
        out = compared(every)
    return out.drop(disputed_in)
