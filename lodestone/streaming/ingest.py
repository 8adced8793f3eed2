"""Incremental ingest: new page files become documents with a domain, an index (chunks and their vectors), production facts with their review items, geological facts, and
the conflicts between documents. A document's new version replaces all that hung on the one before.

Every part is a folder for each batch, which a batch that comes again overwrites. What counts is decided when it is read (``current``): the rows of each document's newest version, so that batches may
come repeated, late or out of order. Conflicts belong to keys (entity, field, period), not to documents: a batch makes those anew of all keys that its documents have touched in any
version, from what counts then, and says which keys these are; of a key the last batch counts that touched it (``current_conflicts``). So a batch costs work in proportion to its documents
and to the facts of their keys, and the store equals one that is built at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import normalize as N
from lodestone.functions.cues import DOMAIN_CUES
from lodestone.operators import corpus as C
from lodestone.operators import extract as T
from lodestone.operators import strata as S
from lodestone.operators import validate as V
from lodestone.operators.evidence import gated
from lodestone.operators.facts import normalized

PAGES = "document_id string, text string, version int"
PARTS = ("documents", "chunks", "vectors", "production", "reviews", "geology")
KEY = ["entity", "field", "period"]
GEOLOGY = "geological_exploration"


def parts_of(pages: DataFrame) -> dict[str, DataFrame]:
    """What a set of documents (document_id, text, version) gives: a row for each with its domain (TXT-6), chunks with ids (TXT-1, TXT-21), their
    sparse vectors (TXT-5), production drafts with their scores (TXT-10, TXT-11), review items for those that need one (REV-1), and geological rows of documents of that domain, or with its score
    (TXT-12, TXT-15, TXT-16)."""
    versions = pages.select("document_id", "version")
    texts = pages.select("document_id", F.lit(1).alias("page_number"), "text")
    domains = C.classify(pages, DOMAIN_CUES, 2.5, 3.0)
    scores = C.cue_counts(pages, {GEOLOGY: DOMAIN_CUES[GEOLOGY]}).select("document_id", F.col(GEOLOGY).alias("score")).join(domains.select("document_id", "domain"), "document_id")
    chunks = C.chunks(pages).withColumn("chunk_id", N.stable_id(F.col("document_id"), F.col("content")))
    words = chunks.select("chunk_id", "content").distinct()
    drafts = T.scored_drafts(T.production_drafts(texts)).drop("text")
    drafts = drafts.withColumn("fact_id", N.stable_id(*(F.col(c) for c in ("document_id", "field", "entity", "year", "value", "unit", "evidence"))))
    found = {
        "documents": domains,
        "chunks": chunks,
        "vectors": C.embeddings(words, "chunk_id", "content").join(chunks.select("chunk_id", "document_id").distinct(), "chunk_id"),
        "production": drafts,
        "reviews": drafts.where("status = 'review_required'").select("document_id", "fact_id", N.priority(F.col("confidence")).alias("priority")).distinct(),
        "geology": S.scored(S.drafts(gated(texts, scores, GEOLOGY))),
    }
    return {name: df.join(versions, "document_id") for name, df in found.items()}


def apply_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Adds one micro-batch (STR-1): its parts go to folders of the batch's number. A batch that comes again overwrites
    its own folders, so that it counts once; documents are written last, so that a batch without them doesn't count yet."""
    newest = batch.groupBy("document_id").agg(F.max_by("text", F.struct("version", "text")).alias("text"), F.max("version").alias("version")).persist()
    try:
        parts = parts_of(newest)
        for name in sorted(parts, key=lambda n: n == "documents"):
            _write(parts[name], path, name, batch_id)
        _settle_conflicts(newest.select("document_id"), batch_id, path)
    finally:
        newest.unpersist()


def _write(df: DataFrame, path: str, part: str, batch_id: int) -> None:
    df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{part}/batch={batch_id}")


def _facts(production: DataFrame) -> DataFrame:
    """Production rows as facts that can be compared."""
    return production.select(F.col("fact_id").alias("id"), "document_id", F.col("field").alias("field_name"), N.plain_number(F.col("value")).alias("numeric_value"), "unit", F.col("entity").alias("entity_name"), F.col("year").alias("financial_year"), "status", F.lit(False).alias("is_calculated")).dropDuplicates(["id"])


def _settle_conflicts(documents: DataFrame, batch_id: int, path: str) -> None:
    """Writes the keys that the documents touch, now or in an older version, and the conflicts of these keys (VAL-1, VAL-2)."""
    spark = documents.sparkSession
    keyed = lambda rows: normalized(_facts(rows)).where("entity is not null and period is not null")
    touched = keyed(spark.read.parquet(f"{path}/production").join(documents, "document_id", "left_semi")).select(*KEY).distinct()
    _write(touched, path, "touched", batch_id)
    touched = spark.read.parquet(f"{path}/touched/batch={batch_id}").select(*KEY)
    facts = keyed(current(spark, path, "production")).join(touched, KEY, "left_semi").drop("entity", "field", "period", "unit_norm", "base_value")
    versions = current(spark, path, "documents").select("document_id", F.col("document_id").alias("filename"), "version")
    _write(V.cross_document(facts, versions), path, "conflicts", batch_id)


def current_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """The conflicts that count: of each key those of the last batch that touched it."""
    last = spark.read.option("basePath", f"{path}/touched").parquet(f"{path}/touched").groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return spark.read.option("basePath", f"{path}/conflicts").parquet(f"{path}/conflicts").join(last, [*KEY, "batch"], "left_semi")


def current(spark: SparkSession, path: str, part: str = "chunks") -> DataFrame:
    """A part's rows of each document's newest version, the later batch for equal ones. A document that now has no rows of the part has none."""
    rows = spark.read.option("basePath", f"{path}/documents").parquet(f"{path}/documents")
    last = rows.groupBy("document_id").agg(F.max(F.struct("version", "batch")).alias("last")).select("document_id", "last.version", "last.batch")
    return spark.read.parquet(f"{path}/{part}").join(last, ["document_id", "version", "batch"], "left_semi")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """Writes what counts of every part to a new store as its batch -1, where later batches are added: the old one may go once readers have moved."""
    for part in sorted(PARTS, key=lambda n: n == "documents"):
        _write(current(spark, path, part), to, part, -1)
    _write(spark.read.parquet(f"{path}/touched").select(*KEY).distinct(), to, "touched", -1)
    _write(current_conflicts(spark, path), to, "conflicts", -1)


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder of page files and ingests what is new, then stops."""
    pages = spark.readStream.schema(PAGES).parquet(source)
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: apply_batch(df, n, path)).start()
