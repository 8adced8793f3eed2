"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles (A-Z lower-cased; a text with fewer words than a
shingle has its whole sequence as one). Two documents link when 100 * |A and B| >= percent * |A or B|.

Signatures (after Arasu, Ganti and Kaushik, 2006): sizes fall into bands; a set also takes part in the next band if
a linked partner may be there. Linked sets of a band differ in at most k elements. The domain of shingles is cut
into n1 parts of N2 sub-parts. Fewer than ``needed`` = k // (K2 + 1) + 1 parts can hold more than K2 differences, so that in some
part of any ``needed`` parts all but K2 sub-parts agree: each subset of N2 - K2 sub-parts, hashed, is a signature.
n1 exceeds ``needed`` by SLACK, so that a set can leave out signatures of few shingles (any two sets would share an empty one): while ``needed`` of
its parts have large signatures alone, one of these is shared with each linked set. A set for which that fails also gives the
signatures of the next partition of the domain; where it fails in the last one too, the set gives all of that partition's. So no linked pair is lost:
if one of the two gives up no signature that it needs in some partition, the other gives the same there, and otherwise both give all of the last.
The first two partitions are of uncommon shingles alone (sets differ in no more of these than in all), which keeps apart texts that merely share a
common passage. Common are shingles that two documents of a sample of SAMPLE have, by hash cell; which they are changes no result.

Plan: a task keeps one document of each set of exact copies that it reads, and of those one for each signature; the pairs that it has found itself
go out as a signature of their own. So a signature that a third of all documents have is sent once a flush of a task. What a flush sends is cut into ranges of
signatures, one row each; there are as many ranges as keep each small, whatever the size of the input. A task sorts one range and joins each document to the smallest that shares a signature.
The components of these joins ("bundles") hold every linked pair. One document of each set of exact copies is compared, exactly, within its bundle.

Texts that share a long passage may chain many others into one bundle, and many near copies of one text make a large one. In a bundle of over SPLIT
shingles all sets are first compared with one of them, its smallest id: those that link with it ("near") are joined, and needn't be compared with each other. Then it is
split by sketches: numbers of shingles by hash cell. The sum of their differences never exceeds the number of shingles that two sets differ in, so pairs above the bound
for links can't link; the components of the other pairs are the new bundles. What is left of over BLOCK shingles is cut into blocks, and every pair of
blocks but those of two near ones is compared by a task of its own, as with sketches. So a bundle of near copies of one text costs work in proportion to it, and only the
others in it meet all. The links that are found make the components. Joins by bundle, by node and by exact copy deal the rows of one key over all partitions.

Nulls and edge cases: null and empty texts (and texts without words) have empty sets, which link with nothing; exact
copies always link; rows with a null doc_id take no part; equal doc_ids are taken as one document for components (whose smallest
text is compared), but each row is returned. Shingles are compared by 64-bit hashes, never by their words: two sets of 1,000 shingles each that share none have a chance of 5e-14 that any two hashes agree, and a
wrong link needs 90 of 100 to agree; exact copies are told by their size and two more 64-bit sums. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Slice, components, lookup, map_slices, partitions, table
from lodestone.llm.textops import Words, in_doc, mix, repeats, shingles

N2, K2, SLACK, LEAST, LAST, GROWTH, BLOCK, FLUSH = 3, 1, 0.25, 2, 6, 1.3, 1 << 20, 1 << 20
CELLS, SPLIT, SKETCHES, COMMON, SAMPLE = 64, 1 << 17, 1 << 12, 22, 1 << 13
#: Shingles of all documents for each partition of signatures, of which there are some one and a half times as many.
PART = 1 << 20


def sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, sorted, and the offsets of documents in them."""
    words = Words(part.buf, part.offsets, lower=True)
    doc = words.doc()
    at = np.flatnonzero(in_doc(words, size))
    docs, found = [doc[at]], [shingles(words.hashes, size)[at]]
    for n in range(1, size):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            docs.append(short)
            found.append(mix(shingles(words.hashes, n)[words.offsets[short]] + np.uint64(n)))
    doc, found = np.concatenate(docs), np.concatenate(found)
    by_doc = np.argsort(doc, kind="stable")
    doc, found = doc[by_doc], found[by_doc]
    order, group, _ = repeats(doc, found)
    first = order[np.flatnonzero(np.diff(group, prepend=-1))] if len(order) else order
    return found[first], np.searchsorted(doc[first], np.arange(len(part) + 1))


def bands(largest: int, percent: int) -> np.ndarray:
    """Smallest size of each band; a set's partner is in its own band or a neighbouring one."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH), (low[-1] - 1) * 100 // percent + 1))
    return np.array([*low, max(low[-1] + 1, int(low[-1] * GROWTH), (low[-1] - 1) * 100 // percent + 1)])


def _scheme(elements: np.ndarray, offsets: np.ndarray, band: np.ndarray, k: np.ndarray, salt: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (one after another, with a band and a bound on differences each) under one partition of the domain: keys, the set that each
    is of, whether it is large enough, and for each set whether enough of its parts have large signatures alone."""
    n = np.diff(offsets)
    needed = k // (K2 + 1) + 1
    n1 = needed + np.ceil(needed * SLACK).astype(np.int64)
    cells = np.concatenate([[0], np.cumsum(n1 * N2)])
    entry = np.repeat(np.arange(len(n)), n)
    e = mix(elements + np.uint64(salt)) if salt else elements
    where = ((e >> np.uint64(32)) * n1[entry].astype(np.uint64)) >> np.uint64(32)
    cell = cells[entry] + where.astype(np.int64) * N2 + ((e & np.uint64(0xFFFFFFFF)) % np.uint64(N2)).astype(np.int64)
    total, many = np.zeros(cells[-1], np.uint64), np.bincount(cell, minlength=cells[-1]).reshape(-1, N2)
    np.add.at(total, cell, mix(e))
    total = total.reshape(-1, N2)
    owner = np.repeat(np.arange(len(n)), n1)
    part = np.arange(len(total)) - np.repeat(np.cumsum(n1) - n1, n1)
    without = np.arange(N2)  # K2 = 1: each subset leaves out one sub-part
    sums, sizes = total.sum(1, dtype=np.uint64)[:, None] - total[:, without], many.sum(1)[:, None] - many[:, without]
    good = np.bincount(owner, (sizes >= least).all(1), len(n)) >= needed
    own = mix((np.uint64(salt) << np.uint64(56)) + (band[owner].astype(np.uint64) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(4)))[:, None] + without.astype(np.uint64)
    return mix(sums + own).ravel(), np.repeat(owner, N2), (sizes >= least).ravel(), good


def _subset(elements: np.ndarray, offsets: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements and offsets of some of the sets."""
    n = np.diff(offsets)[some]
    edge = np.concatenate([[0], np.cumsum(n)])
    return elements[np.arange(edge[-1]) + np.repeat(offsets[some] - edge[:-1], n)], edge


def signatures(elements: np.ndarray, offsets: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signature keys of the sets, and the set that each belongs to. ``common``: flags of the cells of common shingles."""
    n = np.diff(offsets)
    low = bands(int(n.max(initial=0)), percent)
    own = np.searchsorted(low, n, side="right") - 1
    has = np.flatnonzero(n)
    up = has[n[has] * 100 >= percent * low[own[has] + 1]]
    owner, band = np.concatenate([has, up]), np.concatenate([own[has], own[up] + 1])
    k = 2 * (low[np.minimum(band + 1, len(low) - 1)] - 1) * (100 - percent) // (100 + percent)
    owner, band, k = owner[k > 0], band[k > 0], k[k > 0]  # sets that may differ in nothing are copies
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if common is not None:
        rare = ~common[(elements >> np.uint64(64 - COMMON)).astype(np.int64)]
        kept = np.concatenate([[0], np.cumsum(rare)])
        schemes = [(elements[rare], kept[offsets], 0, 1), (elements[rare], kept[offsets], 1, 1)]
    else:
        schemes = []
    schemes += [(elements, offsets, salt, least) for salt, least in ((2, LEAST), (3, LEAST), (4, 1), (5, 1), (LAST, 1))]
    for items, edges, salt, least in schemes:
        if not len(owner):
            break
        key, of, large, good = _scheme(*_subset(items, edges, owner), band, k, salt, least)
        keep = large | ~good[of] if salt == LAST else large
        keys.append(key[keep])
        owners.append(owner[of[keep]])
        owner, band, k = owner[~good], band[~good], k[~good]
    return np.concatenate(keys), np.concatenate(owners)


def first_of_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, smallest id of each, distinct pairs (other id, smallest id) that share a key)."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first, low = _smallest(keys, ids)
    other = ids != low
    return keys[first], low[first], np.unique(np.column_stack([ids[other], low[other]]), axis=0)


def _smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over sorted keys: whether each is the first of its run, and the smallest id of the run, whatever the order of ids in it."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return first, np.minimum.reduceat(ids, np.flatnonzero(first))[np.cumsum(first) - 1] if len(keys) else ids


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (id, smallest id of its component) that join the same ids as the given pairs, one for each id at most."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    out = np.column_stack([ids, ids[label]])
    return out[out[:, 0] != out[:, 1]]


def _pair_key(pairs: np.ndarray) -> np.ndarray:
    """A signature of each pair's own."""
    return mix(mix(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64) + np.uint64(77))


def _signed(keys: np.ndarray, ids: np.ndarray, parts: int) -> pa.RecordBatch:
    """What a task sends: each key with its smallest id, and both ends of the pairs that it has found itself under a key of their own; the keys and ids of each part, a range of keys, in one row."""
    keys, ids, pairs = first_of_key(keys, ids)
    pairs = _forest(pairs)
    own = _pair_key(pairs)
    key, id_ = np.concatenate([keys, own, own]), np.concatenate([ids, pairs[:, 0], pairs[:, 1]]).astype(np.int64)
    order = np.argsort(key)
    key, id_ = key[order], id_[order]
    part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(edge))
    packed = [pa.array([x[edge[p] : edge[p + 1]].tobytes() for p in some], pa.binary()) for x in (key, id_)]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *packed], ["part", "keys", "ids"])


def identities(elements: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each whole set; with its size they tell sets apart."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(elements + np.uint64(s)))]) for s in (1, 2)]
    return [(t[offsets[1:]] - t[offsets[:-1]]).view(np.int64) for t in total]


def _one_of_copies(elements: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each set of copies the place of the one with the smallest id; empty sets have none."""
    n, (h1, h2) = np.diff(offsets), identities(elements, offsets)
    order = np.lexsort((ids, h2, h1, n))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(n[order]) != 0) | (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    return np.sort(order[new & (n[order] > 0)])


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Flags of 2**COMMON hash cells, true where a cell holds a shingle that two of the sampled documents have."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most SAMPLE numbers

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sets(part, size)[0].view(np.int64))], ["shingle"])

        return each

    twice = map_slices(texts, make, "shingle long").groupBy("shingle").count().where("count > 1")
    cells = twice.select(F.shiftrightunsigned("shingle", 64 - COMMON).alias("cell")).distinct().toArrow()["cell"].to_numpy()  # at most 2**COMMON, and those of the sample
    flags = np.zeros(1 << COMMON, bool)
    flags[cells] = True
    return flags


def candidates(docs: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Distinct pairs (a, b) that join documents which share a signature, directly or over others that do. Signatures are dealt over ``parts`` partitions, each of which a task holds."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))  # of fixed size

    def make():
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def each(part: Slice | None) -> pa.RecordBatch | None:
            if part is not None:
                found, offsets = sets(part, size)
                one = _one_of_copies(found, offsets, part.ids)
                keys, owner = signatures(*_subset(found, offsets, one), percent, common.value)
                held.append((keys, part.ids[one[owner]]))
                if sum(len(k) for k, _ in held) < FLUSH:
                    return None
            if not held:
                return None
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _signed(keys, ids, parts)

        return each

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over all rows of a partition: each id of a key with the smallest one."""
        held = [(np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(i.as_buffer(), np.int64)) for b in batches for k, i in zip(b.column("keys"), b.column("ids"), strict=True)]
        if held:
            pairs = first_of_key(*(np.concatenate(x) for x in zip(*held, strict=True)))[2]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    signed = map_slices(docs, make, "part int, keys binary, ids binary", tail=True)
    return signed.repartitionById(parts, "part").mapInArrow(meet, "a long, b long").distinct()


def _linked(ids: np.ndarray, packed: list[np.ndarray], near: np.ndarray, percent: int) -> np.ndarray:
    """The smallest id of each set's component, by exact comparison. Sets that already are in one component (as all near ones are) aren't
    compared; a set first meets one set of each component, then all of the others."""
    order = np.argsort(ids, kind="stable")
    ids, packed, near = ids[order], [packed[i] for i in order], np.flatnonzero(near[order])
    n, offsets = np.array([len(p) for p in packed]), np.concatenate([[0], np.cumsum([len(p) for p in packed])])
    kinds, coded = np.unique(np.concatenate(packed), return_inverse=True)
    root, marked = np.arange(len(ids)), np.zeros(len(kinds), bool)
    root[near] = near[:1]

    def matches(i: int, among: np.ndarray) -> np.ndarray:
        among = among[(n[among] * 100 >= percent * n[i]) & (n[i] * 100 >= percent * n[among])]
        if not len(among):
            return among
        spans = np.concatenate([coded[offsets[j] : offsets[j + 1]] for j in among])
        both = np.add.reduceat(marked[spans].astype(np.int64), np.cumsum(n[among]) - n[among])
        return among[100 * both >= percent * (n[among] + n[i] - both)]

    for i in range(1, len(ids)):
        marked[coded[offsets[i] : offsets[i + 1]]] = True
        for among in (lambda: np.unique(root[:i][root[:i] != root[i]]), lambda: np.flatnonzero(root[:i] != root[i])):
            for r in np.unique(root[matches(i, among())]):
                low, high = sorted((r, root[i]))
                root[root == high] = low
        marked[coded[offsets[i] : offsets[i + 1]]] = False
    return np.column_stack([ids, ids[root]])


def sketch(elements: np.ndarray) -> bytes:
    """Numbers of elements by hash cell, at most 255 each; as many cells (CELLS times a power of two) as a quarter of the elements at least."""
    cells = CELLS
    while 4 * cells < len(elements):
        cells *= 2
    return np.minimum(np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _folded(cells: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(cells.reshape(-1, n).sum(0, dtype=np.int64), 255)


def _alike(ids: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], near: np.ndarray, percent: int) -> np.ndarray:
    """Distinct pairs (id, smallest id) that join the sets which the sketches can't tell to be too different, and all near ones."""
    order = np.argsort(n, kind="stable")
    ids, n, sketches, near = ids[order], n[order], [sketches[i] for i in order], np.flatnonzero(near[order])
    coarse = np.array([_folded(s, CELLS) for s in sketches], np.uint8).T.copy()
    label = np.arange(len(ids))
    label[near] = near[:1]
    reach = np.searchsorted(n * percent, n * 100, side="right")  # sets up to here aren't too large
    for i in range(len(ids)):
        a, b = i + 1, reach[i]
        if a >= b:
            continue
        most = (n[i] + n[a:b]) * (100 - percent) // (100 + percent)
        x = coarse[:, i : i + 1]
        apart = np.add.reduce(np.maximum(coarse[:, a:b], x) - np.minimum(coarse[:, a:b], x), axis=0, dtype=np.int32)
        left = np.flatnonzero(apart <= most)
        while len(left := left[label[a + left] != label[i]]):  # sets that are joined already aren't compared
            j, left = left[0], left[1:]
            cells = min(len(sketches[i]), len(sketches[a + j]))
            if cells == CELLS or np.abs(_folded(sketches[i], cells) - _folded(sketches[a + j], cells)).sum() <= most[j]:
                low, high = sorted((label[i], label[a + j]))
                label[label == high] = low
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    out = np.column_stack([ids, smallest[label]])
    return out[out[:, 0] != out[:, 1]]


def _block_pairs(members: DataFrame, weight: str | int, most: int, largest: int) -> DataFrame:
    """Each member (first_id, root, near) once for every pair of blocks (i, j) of its bundle that its block is in and that is to be compared: all but
    those of two near blocks. A block weighs about ``most`` (sums of a column, or of a number for each member); no bundle has over ``largest`` members."""
    w = F.col(weight) if isinstance(weight, str) else F.lit(weight)
    blocks = lambda near: F.coalesce(F.ceil(F.sum(F.when(F.col("near") == near, w)) / most), F.lit(0)).cast("long")
    sizes = members.groupBy("root").agg(blocks(False).alias("far"), blocks(True).alias("beside"))
    sized = lookup(members, sizes, ["root"], "first_id", largest).where("far > 0")
    own = F.xxhash64("first_id")
    block = F.when(F.col("near"), F.col("far") + F.pmod(own, F.greatest("beside", F.lit(1)))).otherwise(F.pmod(own, "far"))
    others = F.sequence(F.lit(0).cast("long"), F.col("far") + F.when(F.col("near"), 0).otherwise(F.col("beside")) - 1)
    pairs = F.transform(others, lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))
    return sized.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j").drop("p", "far", "beside")


def _near(sets_of: DataFrame, percent: int, largest: int) -> DataFrame:
    """first_id, pivot and near (whether the set links with its bundle's pivot, the member with the smallest id) of large bundles' members,
    which are given as first_id, root, elements. The pivot is near itself."""
    pivots = sets_of.groupBy("root").agg(F.min("first_id").alias("pivot"))
    chosen = sets_of.join(pivots.withColumn("first_id", F.col("pivot")), ["root", "first_id"]).select("root", "pivot", F.col("elements").alias("of_pivot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("elements"), batch.column("of_pivot"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                near.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("first_id"), batch.column("pivot"), pa.array(near, pa.bool_())], ["first_id", "pivot", "near"])

    return lookup(sets_of, chosen, ["root"], "first_id", largest).select("first_id", "pivot", "elements", "of_pivot").mapInArrow(run, "first_id long, pivot long, near boolean")


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for every row of docs."""

    def describe():
        def each(part: Slice) -> pa.RecordBatch:
            found, offsets = sets(part, size)
            h1, h2 = identities(found, offsets)
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(np.diff(offsets)), pa.array(h1), pa.array(h2)], ["doc_id", "n_shingles", "h1", "h2"])

        return each

    about = table(map_slices(docs, describe, "doc_id long, n_shingles long, h1 long, h2 long"), "sets")
    same = ["n_shingles", "h1", "h2"]
    classes = table(about.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    shingles_in_all = about.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(partitions(docs.sparkSession), -(-shingles_in_all // PART))  # as many as keep the signatures of a partition few, whatever the input's size
    bundles = components(candidates(docs, size, percent, parts)).withColumnRenamed("node", "first_id")
    bundled = table(classes.join(bundles, "first_id").select("first_id", "n_shingles", "root"), "bundles")
    sizes = table(bundled.groupBy("root").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("many")).where("many > 1"), "sizes")
    copies, largest = (df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0] for df, c in ((classes, "copies"), (sizes, "many")))
    members = table(lookup(bundled, sizes, ["root"], "first_id", largest).select("first_id", "n_shingles", "root", "total"), "members")

    def pack():
        def each(part: Slice) -> pa.RecordBatch:
            found, offsets = sets(part, size)
            some = [found[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            packed = [pa.array([f(x) for x in some], pa.binary()) for f in (np.ndarray.tobytes, sketch)]
            return pa.RecordBatch.from_arrays([pa.array(part.ids), *packed], ["first_id", "elements", "sketch"])

        return each

    # the one shuffle of texts: those of bundles' members (of rows that share a doc_id, the smallest)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    packed = table(map_slices(texts, pack, "first_id long, elements binary, sketch binary").join(members, "first_id"), "packed")
    beyond = packed.where(F.col("total") > SPLIT)
    large = beyond.select("first_id", "n_shingles", "root")

    def alike(rows: pa.Table) -> pa.Table:
        out = _alike(rows["first_id"].to_numpy(), rows["n_shingles"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint8) for x in rows["sketch"]], rows["near"].to_numpy(), percent)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    def compare(rows: pa.Table) -> pa.Table:
        out = _linked(rows["first_id"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["elements"]], rows["near"].to_numpy(), percent)
        out = out[out[:, 0] != out[:, 1]]
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    pairs = "a long, b long"
    near = table(_near(beyond.select("first_id", "root", "elements"), percent, largest), "near")
    to_pivot = near.where("near and first_id <> pivot").select(F.col("first_id").alias("a"), F.col("pivot").alias("b"))
    sketched = beyond.select("first_id", "n_shingles", "root", "sketch").join(near.select("first_id", "near"), "first_id")
    kept = ["first_id", "n_shingles", "sketch", "near", "root", "i", "j"]
    joined = _block_pairs(sketched, 1, SKETCHES, largest).select(*kept).groupBy("root", "i", "j").applyInArrow(alike, pairs).unionByName(to_pivot)
    split = components(joined).withColumnRenamed("node", "first_id").join(near.select("first_id", "near"), "first_id")
    split = _block_pairs(split.join(large.select("first_id", "n_shingles"), "first_id"), "n_shingles", BLOCK, largest).select("first_id", "near", "root", "i", "j")
    columns = ["first_id", "elements", "near", "root", "i", "j"]
    whole = packed.where(F.col("total") <= SPLIT).select("first_id", "elements", F.lit(False).alias("near"), "root", *(F.lit(0).cast("long").alias(c) for c in "ij"))
    compared = whole.unionByName(beyond.select("first_id", "elements").join(split, "first_id").select(*columns))
    links = compared.groupBy("root", "i", "j").applyInArrow(compare, pairs).unionByName(to_pivot)
    linked = components(links).select(F.col("node").alias("first_id"), "root")
    of_class = classes.join(linked, "first_id", "left").select(*same, F.coalesce("root", "first_id").alias("component_id"))
    full = lookup(about.where("n_shingles > 0").select("doc_id", *same), of_class, same, "doc_id", copies).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(about.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
