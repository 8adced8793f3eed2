"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A change is a row (batch_id, change_id, doc_id, tokenizer, source, lang, old_tokens, new_tokens): an insert has no
old count, a delete no new one, a revised count both. Its signed effect, new less old, is additive, so a
batch adds one small rollup and no total is computed anew. A commit writes the batch's rollup under a fresh attempt
number, then logs (batch_id, attempt); totals() adds one logged attempt of each batch. So a batch that is sent or
retried again counts once, and an attempt that died before its log entry counts never.

Nulls and edge cases: a change with neither count has no effect; a change_id that a batch repeats counts once (that
with the largest values, if they differ); null source, lang or tokenizer are groups of their own; groups without
documents and tokens are left out of the totals. Extra columns are ignored. No changes give no rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe_trie import vocabulary, worker_bpe
from lodestone.llm.shared import Slice, lookup, shared_dir, slices, table

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions that are counted by a pattern: runs of non-space, and words or single marks. Others come from bpe_ledger().
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-1": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}
ROLLUP, LOG = "batch_id long, attempt string, source string, lang string, tokenizer string, docs long, tokens long", "batch_id long, attempt string"


def deltas(changes: DataFrame) -> DataFrame:
    """The signed rollup of the changes, by batch."""
    once = changes.groupBy("batch_id", "change_id").agg(F.max(F.struct(*KEYS, "old_tokens", "new_tokens")).alias("c")).select("batch_id", "c.*")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    docs = F.col("new_tokens").isNotNull().cast("long") - F.col("old_tokens").isNotNull().cast("long")
    return once.groupBy("batch_id", *KEYS).agg(F.sum(docs).alias("docs"), F.sum(n("new_tokens") - n("old_tokens")).alias("tokens"))


class Rollup:
    """Totals kept under one folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"

    def commit(self, changes: DataFrame) -> None:
        """Adds the batches that the changes hold. Adding one again changes nothing."""
        attempt = uuid.uuid4().hex
        found = deltas(changes).withColumn("attempt", F.lit(attempt))
        found.select("batch_id", "attempt", *KEYS, "docs", "tokens").write.mode("append").parquet(f"{self.root}/rollup")
        written = self.spark.read.schema(ROLLUP).parquet(f"{self.root}/rollup").where(F.col("attempt") == attempt)
        written.select("batch_id", "attempt").distinct().write.mode("append").parquet(f"{self.root}/log")

    def totals(self) -> DataFrame:
        log = self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        counted = log.groupBy("batch_id").agg(F.min("attempt").alias("attempt"))
        rows = self.spark.read.schema(ROLLUP).parquet(f"{self.root}/rollup").join(counted, ["batch_id", "attempt"], "left_semi")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def count(text: F.Column, tokenizer: str) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


#: Characters whose absence a revision counts.
SYMBOLS = "#*$%&|<>"


def ledger(docs: DataFrame) -> DataFrame:
    """For each document and pattern tokenizer: its count, its count without symbols, and the first document with its text."""
    plain = F.translate("text", SYMBOLS, "")
    sizes = F.array(*(F.struct(F.lit(t).alias("tokenizer"), count(F.col("text"), t).alias("tokens"), count(plain, t).alias("plain_tokens")) for t in TOKENIZERS))
    rows = docs.where("doc_id is not null").select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.explode(sizes).alias("s")).select("doc_id", "source", "lang", "digest", "s.*")
    return _with_first(rows)


def bpe_ledger(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """The same by a tokenizers file of byte-level BPE, through the encoder of whole texts (bpe_trie), under the version name ``tokenizer``."""
    sent = vocabulary(docs, path)
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("text").cast("string").alias("text"))
    symbol = np.isin(np.arange(256), list(SYMBOLS.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(sent.value)
        for batch in batches:
            at = 0
            for part in slices(batch):
                own = batch.slice(at, len(part))
                at += len(part)
                keep = ~symbol[part.buf]
                edges = np.concatenate([[0], np.cumsum(keep)])[part.offsets]
                counts = [np.diff(bpe.encode(x)[1]) for x in (part, Slice(part.ids, part.buf[keep], edges))]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("doc_id", "source", "lang", "digest")), *(pa.array(c) for c in counts)], ["doc_id", "source", "lang", "digest", "tokens", "plain_tokens"])

    rows = read.mapInArrow(run, "doc_id long, source string, lang string, digest string, tokens long, plain_tokens long")
    return _with_first(rows.withColumn("tokenizer", F.lit(tokenizer)))


def _with_first(rows: DataFrame) -> DataFrame:
    """Adds the first document with the text. Copies of one text, of which there may be any number, meet it over many tasks."""
    table_ = table(rows, "counts")
    keys = ["digest", "tokenizer"]
    first = table(table_.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "firsts")
    most = first.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]
    return lookup(table_, first.drop("copies"), keys, "doc_id", most)


def change_feed(rows: DataFrame, batch_id: int, old: F.Column | None, new: F.Column | None) -> DataFrame:
    none = F.lit(None).cast("long")
    return rows.select(F.lit(batch_id).cast("long").alias("batch_id"), F.concat_ws("/", "doc_id", "tokenizer").alias("change_id"), "doc_id", "tokenizer", "source", "lang", (none if old is None else old).alias("old_tokens"), (none if new is None else new).alias("new_tokens"))
