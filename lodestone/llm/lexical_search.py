"""Ranked lexical search over a length-stratified index.

Terms are runs of letters, digits and all characters beyond ASCII; only A-Z are lower-cased. A document of n terms has the normaliser m = 75 + (25 * n * N) div L, where N documents hold L terms
in all. A term that it holds tf times has the impact (10**9 * tf) div (1000 * tf + 12 * m), so documents of one m, a stratum, have one impact for each tf. A score sums weight * impact
over an item's terms, repeats included, with the weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

1. A map over the texts counts those terms that the items name (``tallies``). A partial count by term gives N, L and df.
2. Documents are grouped by m; a large stratum becomes several blocks of at most BLOCK documents or BLOCK_BYTES of postings. A block's postings stand by term, then by tf, highest first, and so do
   the runs of equal tf, whose impact is computed once. Blocks are rows of a table in the shared folder.
3. The bound of a block for an item is the sum of weight * impact at each term's highest tf. Each item first visits the FIRST blocks with the highest bounds; the lowest of its best ``top``
   scores is its threshold. Then it visits each other block whose bound reaches the threshold, and no others. The threshold rises with what a task finds.
4. The best of all tasks' best are ranked, ties by doc_id.

Scores are whole numbers. Where an item's terms can't reach 2**53 (some 300,000 terms) they are summed as doubles, which is exact and faster, else as 64-bit integers.

Items: their terms' bytes, the thresholds and the visits are broadcast, so they are dealt into groups of about GROUP_BYTES of text by the hash of item_id; each group has an index of its own
terms. Documents' terms are found by a 64-bit hash and then compared by bytes.

Nulls and edge cases: null and empty texts have no terms, are no documents for N, and match nothing; texts of any length are read whole; rows with a null doc_id or item_id take no part; rows that share
a doc_id are documents of their own, and items that share an item_id are one item with the terms of all; items without terms that documents hold have no rows; extra columns stay
away, whatever their names are. Without documents or items there are no rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Slice, map_slices, partitions, table
from lodestone.llm.textops import LOWER, runs, span_hashes

BLOCK, BLOCK_BYTES, FIRST, GROUP_BYTES = 1 << 12, 1 << 20, 4, 1 << 22
#: Worth of an item's terms below which its scores are under 2**53.
EXACT = 1 << 33
LETTER = np.zeros(256, bool)
LETTER[128:] = LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = True
RUNS = "block long, m long, docs binary, term binary, tf binary, many binary, place binary"


def terms_of(text: str | None) -> list[bytes]:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends = runs(LETTER[buf], np.array([0, len(buf)]))
    low = LOWER[buf].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Vocabulary:
    """Distinct terms; finds them among spans of bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = sorted(set(terms))
        raw = np.frombuffer(b"".join(self.terms), np.uint8)
        edges = np.cumsum([0, *map(len, self.terms)])
        self.raw, self.starts, self.sizes = raw, edges[:-1], np.diff(edges)
        self.hashes = span_hashes(raw, edges[:-1], edges[1:]) if self.terms else np.zeros(0, np.uint64)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term of each span, or -1. Terms of one hash are compared one after another."""
        out = np.full(len(starts), -1, np.int64)
        if not self.terms or not len(starts):
            return out
        hashes = span_hashes(buf, starts, ends)
        at = np.searchsorted(self.sorted, hashes)
        left = np.arange(len(starts))
        while len(left := left[(at[left] < len(self.sorted))]) and len(left := left[self.sorted[at[left]] == hashes[left]]):
            term, size = self.order[at[left]], (ends - starts)[left]
            same = self.sizes[term] == size
            wrong = np.zeros(len(left), bool)
            own = np.repeat(np.arange(len(left)), np.where(same, size, 0))
            offset = np.arange(len(own)) - np.repeat(np.cumsum(np.where(same, size, 0)) - np.where(same, size, 0), np.where(same, size, 0))
            wrong[own[buf[starts[left][own] + offset] != self.raw[self.starts[term][own] + offset]]] = True
            hit = same & ~wrong
            out[left[hit]] = term[hit]
            left = left[~hit]
            at[left] += 1
        return out


def tallies(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, n (all terms), and the vocabulary's terms that the document holds, with their tf, as packed 32-bit numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(words)  # terms of one group of items

    def make():
        known = sent.value

        def each(part: Slice) -> pa.RecordBatch:
            buf = LOWER[part.buf]
            starts, ends = runs(LETTER[buf], part.offsets)
            doc = np.searchsorted(part.offsets, starts, side="right") - 1
            term = known.find(buf, starts, ends)
            kind, many = np.unique((doc << 32 | term)[term >= 0], return_counts=True)
            edges = np.searchsorted(kind >> 32, np.arange(len(part) + 1))
            packed = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for x in (kind & 0xFFFFFFFF, many)]
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(np.bincount(doc, minlength=len(part))), *packed], ["doc_id", "n", "terms", "tfs"])

        return each

    return map_slices(docs, make, "doc_id long, n long, terms binary, tfs binary")


def _counts(tallied: DataFrame, size: int) -> dict[int, int]:
    """Documents of each term; under -1 and -2 all documents with a term and all their terms. At most size + 2 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(size, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            total += (int((n > 0).sum()), int(n.sum()))
            for packed in batch.column("terms"):
                df[np.frombuffer(packed.as_buffer(), np.int32)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], total))], ["term", "many"])

    found = tallied.select("n", "terms").mapInArrow(run, "term long, many long").groupBy("term").agg(F.sum("many").alias("many")).toArrow()
    return dict(zip(found["term"].to_pylist(), found["many"].to_pylist(), strict=True))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def index(tallied: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks: their number, m, doc_ids, the runs (term, tf, how many documents) and the places of all runs' documents among the block's."""
    strata = tallied.where("length(terms) > 0").withColumn("m", F.expr(f"75 + (25L * n * {n_docs}L) div {max(1, n_terms)}L")).select("m", "doc_id", "terms", "tfs")
    ordered = strata.repartitionByRange(partitions(tallied.sparkSession), "m", "doc_id").sortWithinPartitions("m", "doc_id")

    def block(number: int, m: int, docs: list, terms: list, tfs: list) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(docs)), [len(t) // 4 for t in terms])
        term, tf = (np.frombuffer(b"".join(x), np.int32) for x in (terms, tfs))
        order = np.lexsort((place, -tf, term))
        term, tf, place = term[order], tf[order], place[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
        first = np.flatnonzero(new)
        packed = (np.array(docs, np.int64), term[first], tf[first], np.diff(np.append(first, len(term))).astype(np.int32), place.astype(np.uint16))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([m]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["block", "m", "docs", "term", "tf", "many", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size, of = TaskContext.get().partitionId() << 32, [[], [], []], 0, None
        for batch in batches:
            for m, doc, terms, tfs in zip(batch.column("m").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("terms").to_pylist(), batch.column("tfs").to_pylist(), strict=True):
                if held[0] and (m != of or len(held[0]) >= BLOCK or size + len(terms) > BLOCK_BYTES):
                    yield block(number, of, *held)
                    number, held, size = number + 1, [[], [], []], 0
                of, size = m, size + len(terms)
                for x, y in zip(held, (doc, terms, tfs), strict=True):
                    x.append(y)
        if held[0]:
            yield block(number, of, *held)

    return ordered.mapInArrow(run, RUNS)


@dataclass
class Items:
    """Items in order of item_id: the distinct terms of each (terms[edges[i] : edges[i + 1]]) and what one unit of impact is worth there."""

    ids: np.ndarray
    edges: np.ndarray
    terms: np.ndarray
    worth: np.ndarray
    size: int

    def bounds(self, row: dict) -> np.ndarray:
        """Each item's highest possible score in a block: a term's first run has its highest tf."""
        term, tf = (np.frombuffer(row[c], np.int32) for c in ("term", "tf"))
        first = np.diff(term, prepend=-1) > 0
        best = np.zeros(self.size, np.int64)
        best[term[first]] = impact(tf[first], row["m"])
        total = np.concatenate([[0], np.cumsum(best[self.terms] * self.worth)])
        return total[self.edges[1:]] - total[self.edges[:-1]]


class Block:
    """A block's postings: of each term a stretch, with an impact for each document in it."""

    def __init__(self, row: dict, size: int):
        term, tf, many = (np.frombuffer(row[c], np.int32) for c in ("term", "tf", "many"))
        self.docs, self.place = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["place"], np.uint16)
        self.impact = np.repeat(impact(tf, row["m"]), many)  # once for each tf of a term
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, many, size).astype(np.int64))])

    def best(self, terms: np.ndarray, worth: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the documents that reach ``least`` (and are above 0), the best ``top``, best first."""
        a, b = self.start[terms], self.start[terms + 1]
        some = [(slice(x, y), w) for x, y, w in zip(a.tolist(), b.tolist(), worth.tolist(), strict=True) if y > x]
        if not some:
            return self.docs[:0], np.zeros(0, np.int64)
        place, value = np.concatenate([self.place[s] for s, _ in some]), np.concatenate([self.impact[s] * w for s, w in some])
        if int(worth.sum()) < EXACT:
            score = np.bincount(place, value, len(self.docs)).astype(np.int64)
        else:
            score = np.zeros(len(self.docs), np.int64)
            np.add.at(score, place, value)
        if len(score) > top:
            least = max(least, np.partition(score, -top)[-top])
        found = np.flatnonzero((score >= least) & (score > 0))
        found = found[np.lexsort((self.docs[found], -score[found]))[:top]]
        return self.docs[found], score[found]


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    docs, score = (np.concatenate(x) for x in zip(one, two, strict=True))
    order = np.lexsort((docs, -score))[:top]
    return docs[order], score[order]


def _visit(blocks: DataFrame, items: Items, chosen: dict[int, np.ndarray], least: np.ndarray | None, top: int) -> DataFrame:
    """item_id, doc_id, score: a task's best of each item. Without ``least``, of the chosen visits; with it, of the visits not among them whose bound reaches it."""
    sent = blocks.sparkSession.sparkContext.broadcast((items, chosen, least))  # of one group of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, chosen, least = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor = np.zeros(len(items.ids), np.int64) if least is None else least.copy()
        for batch in batches:
            for row in batch.to_pylist():
                visits = chosen.get(row["block"], np.zeros(0, np.int64))
                if least is not None:
                    bound = items.bounds(row)
                    visits = np.setdiff1d(np.flatnonzero((bound >= floor) & (bound > 0)), visits, assume_unique=True)
                if not len(visits):
                    continue
                block = Block(row, items.size)
                for i in visits.tolist():
                    a, b = items.edges[i], items.edges[i + 1]
                    found = block.best(items.terms[a:b], items.worth[a:b], floor[i], top)
                    if len(found[0]):
                        best[i] = _merged(best[i], found, top) if i in best else found
                        if len(best[i][0]) == top:
                            floor[i] = max(floor[i], best[i][1][-1])
        for i, (docs, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), items.ids[i])), pa.array(docs), pa.array(score)], ["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _promising(blocks: DataFrame, items: Items) -> dict[int, np.ndarray]:
    """The FIRST blocks of each item by their bounds, as items by block."""
    sent = blocks.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, kept = sent.value, []
        number, bound = (np.zeros((0, len(sent.value.ids)), np.int64) for _ in range(2))
        for batch in batches:
            for row in batch.to_pylist():
                kept.append((row["block"], items.bounds(row)))
            number = np.concatenate([number, *(np.full((1, len(items.ids)), b) for b, _ in kept)])
            bound = np.concatenate([bound, *(x[None] for _, x in kept)])
            order = np.argsort(-bound, axis=0, kind="stable")[:FIRST]
            number, bound, kept = np.take_along_axis(number, order, 0), np.take_along_axis(bound, order, 0), []
        at, item = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(number[at, item]), pa.array(bound[at, item])], ["item", "block", "bound"])

    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
    found = blocks.select("block", "m", "term", "tf").mapInArrow(run, "item long, block long, bound long")
    rows = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).select("item", "block").toArrow()  # FIRST for each item
    out: dict[int, list[int]] = {}
    for item, block in zip(rows["item"].to_pylist(), rows["block"].to_pylist(), strict=True):
        out.setdefault(block, []).append(item)
    return {block: np.array(sorted(some)) for block, some in out.items()}


def _search(docs: DataFrame, group: list[tuple[int, Counter]], top: int) -> DataFrame:
    spark = docs.sparkSession
    words = Vocabulary([t for _, terms in group for t in terms])
    tallied = table(tallies(docs, words), "tallies")
    df = _counts(tallied, len(words.terms))
    n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
    number = {t: i for i, t in enumerate(words.terms)}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for t, i in number.items() if i in df}
    rows = [[(number[t], weight[t] * n) for t, n in terms.items() if t in weight] for _, terms in group]
    flat = np.array([x for row in rows for x in row], np.int64).reshape(-1, 2)
    items = Items(np.array([i for i, _ in group], np.int64), np.cumsum([0, *map(len, rows)]), flat[:, 0], flat[:, 1], len(words.terms))
    blocks = table(index(tallied, n_docs, n_terms), "blocks")
    chosen = _promising(blocks, items)
    first = table(_visit(blocks, items, chosen, None, top), "first")
    least = np.zeros(len(items.ids), np.int64)
    lows = _ranked(first, top).where(F.col("rank") == top).select("item_id", "score").toArrow()  # a number for each item
    least[np.searchsorted(items.ids, lows["item_id"].to_numpy())] = lows["score"].to_numpy()
    return _ranked(first.unionByName(_visit(blocks, items, chosen, least, top)), top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents with the highest scores above 0."""
    spark: SparkSession = docs.sparkSession
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_BYTES))
    found = []
    for g in range(groups):
        some: dict[int, Counter] = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toLocalIterator():  # about GROUP_BYTES of text
            some.setdefault(row["item_id"], Counter()).update(terms_of(row["text"]))
        if any(some.values()):
            found.append(_search(docs, sorted(some.items()), top))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
