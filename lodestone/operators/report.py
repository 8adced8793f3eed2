"""The datasets of a report with their columns: facts, conflicts, geology, resources, evidence, review status, summary and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import among
from lodestone.operators.facts import OPEN, with_document
from lodestone.operators.geology import with_bucket

# Kinds of a resource, labels of review buckets, what warnings say, and the characters of evidence that a report shows.
RESOURCES = ("resource_quantity", "reserve_quantity")
LABELS = {"verified": "Verified", "review_required": "Needs review", "rejected": "Rejected"}
WARNINGS = {
    "facts_pending": "structured geological facts pending human verification.",
    "resources_pending": "resource analytics pending verification.",
    "no_resources": "no compatible resource evidence.",
    "no_thickness": "no compatible seam-thickness evidence.",
}
SHOWN = 500


def _documented(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return with_document(rows.drop("document_name", "document_version"), documents).withColumnRenamed("document_name", "document")


def facts_metrics(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts_Metrics: every index fact with its document. Facts: fact_id, document_id, entity_name, metric, value, unit, period, page."""
    rows = _documented(facts, documents)
    return rows.select(F.col("entity_name").alias("entity"), "metric", "value", "unit", "period", "document", "document_id", "page", "fact_id", F.lit("verified_structured").alias("status"))


def validation_conflicts(conflicts: DataFrame) -> DataFrame:
    """Validation_Conflicts: open conflicts; severity and description are null where they aren't known."""
    known = lambda c: F.col(c) if c in conflicts.columns else F.lit(None).cast("string").alias(c)
    return conflicts.where(among(F.col("status"), OPEN)).select(F.col("entity_name").alias("entity"), F.col("field_name").alias("field"), "period", known("severity"), "status", known("description"))


def geological_facts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Geological_Facts: typed rows that aren't rejected, with what still needs a review."""
    out = _documented(with_bucket(rows), documents)
    return out.select(
        F.col("id").alias("fact_id"), F.col("kind").alias("metric_kind"), "seam", "formation", F.col("borehole_id").alias("borehole"), F.col("value_num").alias("value"), F.col("length_unit").alias("unit"), "status", "document", "document_id",
        F.col("source_page").alias("page"), (F.col("bucket") == "review_required").alias("requires_review"))


def resources(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Resources: quantities by seam. In each document verified rows alone, if it has any, else all that aren't rejected (WIN-5)."""
    found = with_bucket(rows).where(among(F.col("kind"), RESOURCES))
    certain = found.groupBy("document_id").agg(F.bool_or(F.col("bucket") == "verified").alias("certain"))
    kept = found.join(certain, "document_id").where(~F.col("certain") | (F.col("bucket") == "verified"))
    return _documented(kept, documents).select("seam", F.col("value_num").alias("value"), F.col("length_unit").alias("unit"), F.col("source_page").alias("page"), "status", "document", F.col("id").alias("fact_id"))


def evidence_sources(rows: DataFrame, documents: DataFrame, most: int = SHOWN) -> DataFrame:
    """Evidence_Sources: the first ``most`` rows that aren't rejected, by document, page and id, with the first 500 characters of their evidence."""
    told = F.col("evidence_text") if "evidence_text" in rows.columns else F.lit(None).cast("string")
    label = F.coalesce(*(F.when(F.col("bucket") == b, F.lit(x)) for b, x in LABELS.items()))
    first = with_bucket(rows).orderBy("document_id", "source_page", "id").limit(most)
    return _documented(first, documents).select(F.col("id").alias("fact_id"), "document", "document_id", F.col("source_page").alias("page"), label.alias("status"), F.col("kind").alias("metric"), F.col("value_num").alias("value"), F.substring(told, 1, 500).alias("evidence"))


def warnings(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """What a report warns of (AGG-26): document_id, document, warning. One aggregate tells of each document with typed rows whether its facts and resources are all unverified,
    and whether it has resources and seam thicknesses at all; rejected rows count for nothing."""
    kept = F.col("bucket") != "rejected"
    count = lambda test: F.count_if(kept & test)
    verified, resource, thickness = F.col("bucket") == "verified", among(F.col("kind"), RESOURCES), F.col("kind") == "seam_thickness"
    each = rows.groupBy("document_id").agg(count(F.lit(True)).alias("n"), count(verified).alias("v"), count(resource).alias("r"), count(resource & verified).alias("rv"), count(thickness).alias("t"))
    signs = {"facts_pending": "n > 0 and v = 0", "resources_pending": "r > 0 and rv = 0", "no_resources": "r = 0", "no_thickness": "t = 0"}
    said = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(WARNINGS[k])) for k, test in signs.items())))
    return _documented(each.select("document_id", F.explode(said).alias("warning")), documents).select("document_id", "document", "warning")


def review_status(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Audit_Review_Status: metric and count of what awaits a review, what was rejected and so left out, and open conflicts; pending_verification is 1 where anything awaits one. Empty tables count 0."""
    n = rows.agg(F.count_if(F.col("bucket") == "review_required").alias("review_required_count"), F.count_if(F.col("bucket") == "rejected").alias("rejected_excluded"))
    n = n.withColumn("pending_verification", (F.col("review_required_count") > 0).cast("bigint"))
    both = n.join(F.broadcast(conflicts.agg(F.count_if(among(F.col("status"), OPEN)).alias("open_conflicts"))))  # two single rows
    return both.unpivot([], ["review_required_count", "rejected_excluded", "pending_verification", "open_conflicts"], "metric", "count")


def summary(facts: DataFrame, rows: DataFrame, conflicts: DataFrame, title: Column | None = None, domain: str = "combined") -> DataFrame:
    """Summary: field and value (as text) of a report: title, domain, documents, numbers of facts, and the counts of the review status."""
    kept = with_bucket(rows)
    sources = facts.select("document_id").union(kept.select("document_id")).distinct()
    count = lambda df, name: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("field"), "value")
    texts = facts.sparkSession.range(1).select(F.explode(F.create_map(F.lit("title"), title if title is not None else F.lit("Combined report"), F.lit("domain"), F.lit(domain))).alias("field", "value"))
    states = review_status(rows, conflicts).select(F.col("metric").alias("field"), F.col("count").cast("string").alias("value"))
    out = texts
    for part in (count(sources, "documents"), count(facts, "fact_count"), count(kept, "geo_fact_count"), states):
        out = out.unionByName(part)
    return out


def datasets(facts: DataFrame, rows: DataFrame, conflicts: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """All datasets of a report by name (SNK-2, AGG-26), for store.write_report(). Index facts, typed geological rows, conflicts and documents may each be empty. ``documents`` has one row a document_id."""
    return {
        "Summary": summary(facts, rows, conflicts),
        "Facts_Metrics": facts_metrics(facts, documents),
        "Validation_Conflicts": validation_conflicts(conflicts),
        "Geological_Facts": geological_facts(rows, documents),
        "Resources": resources(rows, documents),
        "Evidence_Sources": evidence_sources(rows, documents),
        "Audit_Review_Status": review_status(rows, conflicts),
        "Warnings": warnings(rows, documents),
    }
