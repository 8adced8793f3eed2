"""Helpers that the operators of this subpackage share: where intermediate tables go, and running a
function over bounded slices of text inside Spark tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text and number of documents that a task works on at once; a longer document makes a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 12


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. A local session (as in tests) that names none
    gets a new temporary folder; on a cluster that would be a disk of the driver's alone, so it is refused."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The folders that the running block of ``tables`` has written, oldest first; each thread or task of the driver has its own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tables(spark: SparkSession) -> Iterator[list[str]]:
    """Within the block, table() lists what it writes. What ends it with an error leaves no table; else the caller removes what it needs no more."""
    mine: list[str] = []
    token = _written.set(mine)
    try:
        yield mine
    except BaseException:
        remove_tables(spark, mine)
        raise
    finally:
        _written.reset(token)


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: later steps start from the
    file, so a lost executor costs only the tasks that it ran. The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    if (mine := _written.get()) is not None:
        mine.append(path)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a table in the shared folder."""
    return table(df, "cut")


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more, and takes them off the list."""
    jvm = spark.sparkContext._jvm
    while paths:
        at = jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def learns(of: int, held_out: int) -> F.Column:
    """True for the rows that a model may learn from: crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of != held_out


class Slice:
    """A few documents: their ids, their bytes one after another, and where each begins."""

    def __init__(self, ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
        self.ids, self.buf, self.offsets = ids, buf, offsets

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Cuts a batch with the columns doc_id and text into slices of about ``most`` bytes and at most ``rows`` documents. Null texts are empty."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    text = batch.column("text")
    text = (text.fill_null("") if text.null_count else text).cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(ids):
        b = min(a + rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1))
        yield Slice(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def map_slices(docs: DataFrame, make: Callable[[], Callable[[Slice | None], pa.RecordBatch | None]], schema: T.StructType | str, tail: bool = False, rows: int = SLICE_ROWS) -> DataFrame:
    """Runs a function over slices of (doc_id, text), in tasks. ``make`` runs once for each task and returns
    the function; with ``tail`` it is called once more with None at the task's end. Rows without doc_id take no part.
    ``rows``: the most documents of a slice, for functions that need memory for each document."""
    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch, rows=rows):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out
        if tail and (out := each(None)) is not None and out.num_rows:
            yield out

    return kept.mapInArrow(run, schema)


def spread(order: np.ndarray, bucket: np.ndarray, columns: dict[str, np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """One row for each bucket that has entries: the bucket and, for each column, its entries' bytes one after
    another. ``order`` sorts the entries by bucket."""
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    arrays = [pa.array(full.astype(np.int32))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        at = np.concatenate([edges[full], edges[-1:]]) * values.itemsize
        arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(values.view(np.uint8).data)]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The entries that the rows of a packed column hold, as one array."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column if x.as_py() is not None)])


#: Rows of one key that a join leaves to one task (a few numbers each: some 30 MB).
MOST_OF_KEY = 1 << 20


def lookup(rows: DataFrame, found: DataFrame, on: list[str], by: str, most: int, how: str = "inner") -> DataFrame:
    """Joins rows, of which up to ``most`` share a key, with ``found``, which has one row for each key. Where that is over MOST_OF_KEY, the rows of a key are
    dealt over as many tasks as the session has partitions, by the hash of column ``by``, and each of these gets the key's row. ``how``: inner or left."""
    if most <= MOST_OF_KEY:
        return rows.join(found, on, how)
    salt = fresh(rows, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(partitions(rows.sparkSession))))
    wanted = dealt.select(*on, salt).distinct().join(found, on)  # at most one row for each partition and key
    return dealt.join(wanted, [*on, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every node but roots has one neighbour, its root. Each step is a partial
    aggregate and a join by node, cut by a checkpoint; three numbers reach the driver. The
    edges of a node with over MOST_OF_KEY are dealt over many tasks."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    larger = F.coalesce(F.sum(F.when(F.col("b") > F.col("a"), 1)), F.lit(0)).alias("larger")
    smaller = F.coalesce(F.sum(F.when(F.col("b") < F.col("a"), 1)), F.lit(0)).alias("smaller")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        unsettled = F.col("smaller") + F.least("smaller", "larger") > 1
        state = both.groupBy("a").agg(smaller, larger).agg(F.sum(unsettled.cast("long")).alias("left"), F.max(F.col("smaller") + F.col("larger")).alias("most")).first()
        if not state["left"]:
            break
        low = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")).select("b", F.least("b", "m").alias("m"))
        large = lookup(now, low, ["b"], "a", state["most"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, low, ["a"], "b", state["most"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
