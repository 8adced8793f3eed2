"""Which documents may give evidence for a spec: a cascade from documents that are compared over the selected one to those that a name resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import blank_as_null
from lodestone.operators.facts import one_per
from lodestone.operators.retrieve import resolve_documents
from lodestone.sources.cut import ensure_checkpoints

# How many documents a name resolves to, by route.
NAMED_WHEN_COMPARED, NAMED_BESIDE_SELECTED, NAMED_ALONE = 3, 5, 8


def families(documents: DataFrame) -> DataFrame:
    """document_id, family and what orders versions: files of one name (without its extension) are one family, a file without a name is its own."""
    return documents.select("document_id", F.coalesce(blank_as_null(N.family_key(F.col("filename"))), F.concat(F.lit("\u0000"), F.col("document_id"))).alias("family"), F.coalesce("version", F.lit(1)).alias("version"), "created_at")


def _newest() -> Column:
    return F.struct("version", "created_at", "document_id")


def _active() -> Column:
    return F.coalesce(blank_as_null(F.trim("selected_id")), blank_as_null(F.trim("session_id")))


def scopes(asks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scope of each spec and the documents in it (RET-14), the first route that holds:

    - cross: documents that its names resolve to, three for each;
    - a geological spec that says "this report" with nothing selected: an empty scope, which means nothing;
    - a geological spec with a selected document, else the session's: that document alone; but where it names a place, doesn't say "this report", and all that the name resolves to lies
      outside the selected one's family, those;
    - a name that resolves to documents: those;
    - all documents (``open``).

    Whatever resolves brings the whole families of its documents in, so that all copies of a report can be read; the primary document is the newest resolved one of the family that holds the best match
    (of a comparison the newest of that family). An open scope is no rows with ``open``; an empty one no rows without it. Asks: spec_id, entity, entities (array), selected_id, session_id,
    geological, cross, deictic, names_place; documents: document_id, filename, version, created_at. Null flags are false. A selected document that isn't there stays in scope, so that nothing else is.
    Returns (spec_id, mode, reason, open, primary_id, n_families) and (spec_id, document_id)."""
    ensure_checkpoints(asks.sparkSession)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    names = F.when(F.size(F.coalesce("entities", F.array())) > 0, F.col("entities")).otherwise(F.array("entity"))
    a = asks.select("spec_id", "entity", _active().alias("active"), *(yes(c).alias(c) for c in ("geological", "cross", "deictic", "names_place")), names.alias("names"))
    wanted = F.when(F.col("cross"), F.array_distinct(F.array_compact("names"))).otherwise(F.array_compact(F.array("entity")))
    said = a.select("spec_id", "cross", "active", F.posexplode(wanted).alias("at", "phrase"))
    kin = families(documents)
    hits = resolve_documents(said.select("phrase").distinct(), documents, n=NAMED_ALONE).select("phrase", "document_id", F.col("rank").alias("match"))
    met = said.join(hits, "phrase").join(kin, "document_id")
    own = a.where("active is not null and not cross and geological").select("spec_id", F.col("active").alias("document_id")).join(kin, "document_id").select("spec_id", F.col("family").alias("own_family"))
    met = met.join(own, "spec_id", "left").withColumn("inside", F.coalesce(F.col("family") == F.col("own_family"), F.lit(False))).checkpoint()  # names resolve once
    beside = met.where(f"match <= {NAMED_BESIDE_SELECTED}").groupBy("spec_id").agg(F.count("*").alias("n_beside"), F.bool_or("inside").alias("any_inside"))
    routed = a.join(beside, "spec_id", "left").withColumn("n_beside", F.coalesce("n_beside", F.lit(0)))
    chosen = F.col("active").isNotNull() & F.col("geological")
    elsewhere = F.col("names_place") & ~F.col("deictic") & (F.col("n_beside") > 0) & ~F.coalesce("any_inside", F.lit(False))
    reason = (
        F.when(F.col("cross"), "cross_document_comparison")
        .when(F.col("deictic") & F.col("active").isNull() & F.col("geological"), "deictic_missing_current_document")
        .when(chosen & elsewhere, "entity_other_document")
        .when(chosen & F.col("deictic"), "current_document_deictic")
        .when(chosen, "current_document_geological_default")
        .when(F.col("n_beside") > 0, "entity_resolved")
        .otherwise("unscoped")
    )
    routed = routed.select("spec_id", "active", reason.alias("reason")).checkpoint()
    most = F.when(F.col("reason") == "cross_document_comparison", NAMED_WHEN_COMPARED).when(F.col("reason") == "entity_other_document", NAMED_BESIDE_SELECTED).when(F.col("reason") == "entity_resolved", NAMED_ALONE)
    named = met.join(routed.select("spec_id", "reason"), "spec_id").where(F.col("match") <= most)
    found = named.groupBy("spec_id", "reason", "family").agg(F.min(F.struct("at", "match", "document_id")).alias("first"), F.max_by("document_id", _newest()).alias("newest"))
    heads = kin.groupBy("family").agg(F.max_by("document_id", _newest()).alias("head"))
    best = one_per(found, ["spec_id"], ["first"]).join(heads, "family").select("spec_id", F.when(F.col("reason") == "cross_document_comparison", F.col("head")).otherwise(F.col("newest")).alias("named_id"))
    counted = found.groupBy("spec_id").agg(F.count("*").alias("n_families"))
    alone = F.col("reason").startswith("current_document")
    allowed = found.select("spec_id", "family").join(kin.select("family", "document_id"), "family").select("spec_id", "document_id").unionByName(routed.where(alone).select("spec_id", F.col("active").alias("document_id")))
    n = F.coalesce("n_families", F.when(alone, 1).otherwise(0))
    mode = F.when(F.col("reason") == "cross_document_comparison", "cross_document_comparison").when(alone | (F.col("reason") == "deictic_missing_current_document") | (n == 1), "single_document").otherwise("multi_document")
    out = routed.join(best, "spec_id", "left").join(counted, "spec_id", "left")
    return out.select("spec_id", mode.alias("mode"), "reason", (F.col("reason") == "unscoped").alias("open"), F.when(alone, F.col("active")).otherwise(F.col("named_id")).alias("primary_id"), n.cast("long").alias("n_families")), allowed


def in_scopes(hits: DataFrame, scope: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits (spec_id, document_id, ...) whose document is in their spec's scope (FLT-14): all of an open scope, none of an empty one."""
    rows = hits.join(scope.select("spec_id", F.col("open").alias("_open")), "spec_id").join(allowed.select("spec_id", "document_id", F.lit(True).alias("_in")), ["spec_id", "document_id"], "left")
    return rows.where("_open or _in").drop("_open", "_in")


def without_copies_of_pages(hits: DataFrame) -> DataFrame:
    """The best hit of each spec, file family, page, first eighty characters and value: copies of one report that a scope brings in count once. Hits: spec_id, id, filename, page, text, value, score."""
    start = F.substring(F.trim(F.regexp_replace(F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 160)), "[^a-z0-9]+", " ")), 1, 80)
    return one_per(hits, ["spec_id", N.family_key(F.col("filename")), "page", start, "value"], [F.desc("score"), "id"])
