"""Stewardship: review queues, reviewers' actions, correction history, versions and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.functions.text import among
from lodestone.operators.facts import one_per

DONE = {"approve": "approved", "reject": "rejected", "correct": "corrected"}


def queue(facts: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Items for facts that need a review, most urgent first by priority (REV-1); not for those that have an open item."""
    out = facts.where("status = 'review_required'").select(F.col("id").alias("fact_id"), F.lit("pending").alias("status"), N.priority(F.col("confidence_score")).alias("priority"))
    return out.join(items.where("status = 'pending'").select("fact_id"), "fact_id", "left_anti") if items is not None else out


def synchronize(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Items after a pass over all facts (REV-2): missing ones are enqueued, those of settled facts closed, those without a fact dropped."""
    need = facts.select(F.col("id").alias("fact_id"), (F.col("status") == "review_required").alias("needs"), N.priority(F.col("confidence_score")).alias("new_priority"))
    both = need.join(items.select("fact_id", "status", "priority"), "fact_id", "full_outer").where("needs is not null and (needs or status is not null)")
    pending = F.coalesce(F.col("status"), F.lit("pending")) == "pending"
    return both.select("fact_id", F.when(F.col("needs") & pending, "pending").when(pending, "closed").otherwise(F.col("status")).alias("status"), F.coalesce("priority", "new_priority").alias("priority"))


def first_actions(actions: DataFrame) -> DataFrame:
    """The first action on each item; later ones find it settled."""
    return one_per(actions, ["fact_id"], ["acted_at", "seq"])


def apply_actions(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """Facts after their reviews (REV-3): only facts that wait for one change; a correction keeps the original and counts up the version."""
    done = first_actions(actions).select(F.col("fact_id").alias("id"), "action", "corrected_value")
    open_ = (F.col("status") == "review_required") & F.col("action").isNotNull()
    corrected = open_ & (F.col("action") == "correct")
    out = facts.join(done, "id", "left")
    version = F.coalesce("fact_version", F.lit(1)) if "fact_version" in facts.columns else F.lit(1)
    state = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("corrected")
    return out.select("id", F.when(open_, state).otherwise(F.col("status")).alias("status"), F.when(corrected, F.col("corrected_value")).otherwise(F.col("numeric_value")).alias("numeric_value"), F.col("numeric_value").alias("original_value"), (version + F.when(corrected, 1).otherwise(0)).cast("int").alias("fact_version"))


def apply_geological_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Typed geological rows after their reviews (REV-3): an approval or rejection sets the status; a correction rewrites the value of the row's kind, keeps
    the original and reads lengths anew in metres. Rows: id, status, kind, value, unit, metres; actions: fact_id, action, corrected_value (text), corrected_unit,
    acted_at, seq. Rejected rows are settled; a correction that is no number keeps its text and has no metres."""
    done = first_actions(actions).select(F.col("fact_id").alias("id"), "action", "corrected_value", "corrected_unit")
    open_ = F.col("action").isNotNull() & (F.col("status") != "rejected")
    corrected = open_ & (F.col("action") == "correct")
    unit = F.coalesce("corrected_unit", "unit")
    length = F.col("kind").rlike("thickness|depth")
    state = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("corrected")
    return rows.join(done, "id", "left").select(
        "id", F.when(open_, state).otherwise(F.col("status")).alias("status"), F.when(corrected, F.col("corrected_value")).otherwise(F.col("value")).alias("value"), F.when(corrected, unit).otherwise(F.col("unit")).alias("unit"),
        F.when(corrected & length, G.to_metres(N.plain_number(F.col("corrected_value")), unit)).when(corrected, F.lit(None)).otherwise(F.col("metres")).alias("metres"), F.when(corrected, F.col("value")).alias("original_value"))


def history(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """Corrections with the values before and after (REV-4)."""
    done = first_actions(actions).where("action = 'correct'").withColumnRenamed("fact_id", "id")
    return facts.where("status = 'review_required'").join(done, "id").select("id", F.col("numeric_value").alias("original_value"), "corrected_value", "reviewer", "acted_at")


def version_numbers(documents: DataFrame) -> DataFrame:
    """Versions of each file family in order of arrival, and what each one replaces (REV-5, WIN-6)."""
    w = Window.partitionBy(N.family_key(F.col("filename"))).orderBy("created_at", "document_id")
    return documents.withColumns({"version": F.row_number().over(w), "replaces": F.lag("document_id").over(w)})


def version_roots(documents: DataFrame) -> DataFrame:
    """The first document of every chain of ``replaces`` links, by pointer doubling: each round follows links twice as far, so
    a chain of n versions takes about log2(n) joins (REV-5). Documents whose links end in a circle have no root: null."""
    now = documents.select("document_id", F.coalesce("replaces", "document_id").alias("root"))
    for _ in range(documents.count().bit_length() + 1):
        step = now.select(F.col("document_id").alias("root"), F.col("root").alias("next"))
        new = now.join(step, "root", "left").select("document_id", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")).checkpoint()
        now = new.select("document_id", "root")
        if not new.where("moved").limit(1).count():
            return now
    return new.select("document_id", F.when(~F.coalesce("moved", F.lit(False)), F.col("root")).alias("root"))


def audit(log: DataFrame, n: int = 500) -> DataFrame:
    """The newest entries of the audit log, without sensitive details (REV-6)."""
    return log.withColumn("details", N.sanitize(F.col("details"))).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def detail(documents: DataFrame, facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Each document with its facts, one row for each, which carries the fact as a struct (in page order where sorted by it) with its open conflicts (JN-10, JN-17); a document
    without facts has one row without. A document may hold any number of facts, so they make no list; a page of them is facts.first_of."""
    open_ = conflicts.where(among(F.col("status"), ("review_required", "detected", "confirmed"))).groupBy("fact_id").agg(F.array_sort(F.collect_set("fingerprint")).alias("conflicts"))
    rows = facts.join(open_, facts["id"] == open_["fact_id"], "left").select("document_id", F.struct("page_number", "id", "field_name", "value", "status", "conflicts").alias("fact"))
    return documents.join(rows, "document_id", "left")
