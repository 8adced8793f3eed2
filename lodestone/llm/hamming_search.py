"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors' BITS signs after a rotation learned on a bounded sample (iterative quantization). A code is cut into
substrings of 8 bits, each indexed by its value. Two codes within ``radius`` differ, by the pigeonhole principle, in at
most t_s bits of some substring s where the sum of t_s + 1 exceeds the radius; probing all values within t_s of the query's in
each index finds every such code. Full Hamming distances are taken for the codes found, and inner products in double precision for those of them
within the radius. The radius is learned on the sample, so that it holds ``recall`` of the sample's exact neighbours; where a block holds
fewer than k codes within it, it grows for that query until k are found.

Plan: rows and queries are dealt into blocks of bounded size by hash; each pair of a query block and a row block is a
task with its own index, and a window keeps the k best of each query. Every row is indexed; nothing is sampled but for learning.

Nulls and edge cases: vectors that are null, zero, hold null or non-finite components, or haven't the commonest length (the
larger of equally common ones), and rows with a null vec_id take no part. Rows with an equal vec_id are candidates each, but
none for each other. Ties go to the smaller vec_id. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import table

BITS, SUB, ROWS, QUERIES = 128, 8, 1 << 14, 1 << 12
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_APART = _ONES[np.arange(256)[:, None] ^ np.arange(256)]


class Coder:
    """Centre, rotation and search radius."""

    def __init__(self, centre: np.ndarray, rotation: np.ndarray, radius: int):
        self.centre, self.rotation, self.radius = centre, rotation, radius

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, BITS / 8) bytes."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint8)
    for s in range(a.shape[1]):
        out += _ONES[a[:, s, None] ^ b[None, :, s]]
    return out


def fit(x: np.ndarray, k: int, recall: float, rounds: int = 30, seed: int = 3) -> Coder:
    """Learns the rotation by alternating signs and orthogonal fits, then the radius on pairs of the sample."""
    rng, centre = np.random.default_rng(seed), x.mean(0) if len(x) else np.zeros(x.shape[1])
    y = x - centre
    blocks = []
    for _ in range(-(-BITS // x.shape[1])):
        r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, v = np.linalg.svd(y.T @ np.sign(y @ r))
            r = u @ v
        blocks.append(r)
    coder = Coder(centre, np.hstack(blocks)[:, :BITS], BITS)
    if len(x) > k + 1:
        q = np.arange(min(len(x), 256))
        score = x[q] @ x.T
        score[q, q] = -np.inf
        near = np.argsort(-score, axis=1)[:, :k]
        codes = coder.codes(x)
        found = np.take_along_axis(distances(codes[q], codes), near, axis=1)
        coder.radius = int(np.quantile(found, recall, method="higher"))
    return coder


def limits(radius: int) -> list[int]:
    """t_s of each substring; the sum of t_s + 1 is radius + 1."""
    n = BITS // SUB
    return [(radius + 1) // n + (s < (radius + 1) % n) - 1 for s in range(n)]


class Index:
    """The codes of a block of rows, and for each substring the rows in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.words = self.codes.view(np.uint64)
        self.rows = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.edges = [np.searchsorted(codes[r, s], np.arange(257)) for s, r in enumerate(self.rows)]

    def found(self, query: np.ndarray, radius: int) -> np.ndarray:
        """The rows that probing with a query's code finds: a superset of those within the radius."""
        hit = np.zeros(len(self.codes), bool)
        for s, t in enumerate(limits(radius)):
            if t < 0:
                continue
            e = self.edges[s]
            for value in np.flatnonzero((_APART[query[s]] <= t) & (e[1:] > e[:-1])):
                hit[self.rows[s][e[value] : e[value + 1]]] = True
        return np.flatnonzero(hit)

    def within(self, query: np.ndarray, radius: int, k: int) -> np.ndarray:
        """The rows whose codes lie within the radius, which grows until k rows do (or there are no more)."""
        k, word = min(k, len(self.codes)), query.view(np.uint64)
        while True:
            rows = self.found(query, radius)
            near = rows[np.bitwise_count(self.words[rows] ^ word).sum(1) <= radius]
            if len(near) >= k or radius >= BITS:
                return near
            radius = min(BITS, radius + SUB)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, sample: int = 4_096, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every query among the rows with another vec_id.
    Both inputs have vec_id and embedding. The coder is fitted on ``sample`` rows with the smallest hashes of vec_id."""
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        fine = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    every, asked = usable(rows), usable(queries)
    common = every.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    every, asked = (df.where(F.size("embedding") == dim) for df in (every, asked))
    learned = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    coder = spark.sparkContext.broadcast(fit(_matrix(learned["embedding"], dim), k, recall))

    def code(batches):
        for b in batches:
            found = coder.value.codes(_matrix(pa.chunked_array([b.column("embedding")]), dim)) if b.num_rows else np.zeros((0, BITS // 8), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array([c.tobytes() for c in found], pa.binary())], ["vec_id", "embedding", "code"])

    schema = "vec_id long, embedding array<double>, code binary"
    index = table(every.mapInArrow(code, schema), "codes")
    questions = table(asked.mapInArrow(code, schema), "queries")
    n_rows, n_queries = index.count(), questions.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, asks: bool) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "code"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).withColumn("asks", F.lit(asks))

    both = dealt(index, "r", row_blocks, "q", query_blocks, False).unionByName(dealt(questions, "q", query_blocks, "r", row_blocks, True))

    def nearest(part: pa.Table) -> pa.Table:
        asks = part["asks"].to_numpy()
        x, ids = _matrix(part["embedding"], dim), part["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        r, r_ids, index, out = x[~asks], ids[~asks], Index(codes[~asks]), []
        for q, q_id, code in zip(x[asks], ids[asks], codes[asks], strict=True):
            near = index.within(code, coder.value.radius, k + int((r_ids == q_id).sum()))
            near = near[r_ids[near] != q_id]
            score = np.einsum("ij,j->i", r[near], q)
            if len(near) > 4 * k:  # those below the k-th score can't be among the best
                top = score >= np.partition(score, len(score) - k)[len(score) - k]
                near, score = near[top], score[top]
            best = np.lexsort((r_ids[near], -score))[:k]
            out.append((np.full(len(best), q_id), r_ids[near[best]], score[best]))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    found = both.groupBy("q", "r").applyInArrow(nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
