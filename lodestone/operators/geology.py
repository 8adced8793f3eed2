"""Geological facts: filters, roll-ups by formation, seam and borehole, and comparisons of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.functions.text import among, strip
from lodestone.operators.facts import contains_ci, once, one_per
from lodestone.sources.cut import stored

QUANTITY = ("resource_quantity", "reserve_quantity")


def typed(rows: DataFrame) -> DataFrame:
    """Adds kind, bucket, seam, formation (null unless plausible), borehole_key and metres to stored rows."""
    name, words = F.col("geological_formation"), F.col("_words")
    keyed = once(rows, _kind=G.metric_kind_key(F.col("metric_kind")), _seam=G.seam_body(F.col("seam_name")), _seam_status=F.lower(strip(F.col("seam_status"))), _words=G.words_of(name))
    keyed = once(keyed, _plain=F.when(words.isNotNull(), G.without_leading(words)), borehole_key=G.borehole_key(F.col("borehole_id")), kind=G.metric_kind_of(F.col("_kind")), seam=G.seam_label_of(F.col("_seam"), F.col("_seam_status")))
    keyed = once(keyed, _low=G.lower_words(F.col("_plain")), _bare=G.bare_formation(F.col("_plain")))
    keyed = once(keyed, _proper=G.proper_words(F.col("_low")))
    formation = F.when(G.plausible_words(name, F.col("_low"), F.col("_proper")), G.formation_of(F.col("_bare")))
    out = once(keyed, formation=formation, metres=G.to_metres(F.col("value_num"), F.col("length_unit"))).withColumn("bucket", N.status_bucket(F.col("status")))
    return out.select(*rows.columns, "kind", "bucket", "seam", "formation", "borehole_key", "metres")


def with_bucket(rows: DataFrame, bucket: str | None = None) -> DataFrame:
    """Rows of a status bucket; without one all but the rejected; ``all`` for every row (FLT-3)."""
    if bucket == "all":
        return rows
    return rows.where(F.col("bucket") == bucket) if bucket else rows.where("bucket <> 'rejected'")


def browse(rows: DataFrame, document_id: str | None = None, seam: str | None = None, borehole: str | None = None, kind: str | None = None, bucket: str | None = None) -> DataFrame:
    """Typed rows that answer a browsing selection (FLT-3): seam and borehole by parts of the stored names, metric by compatibility."""
    out = with_bucket(rows, bucket)
    out = out.where(F.col("document_id") == document_id) if document_id else out
    out = out.where(contains_ci("seam_name", seam)) if seam else out
    out = out.where(contains_ci("borehole_id", borehole)) if borehole else out
    return out.where(G.metrics_compatible(G.metric_kind(F.lit(kind)), F.col("kind"))) if kind else out


def of_formation(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a formation, and those whose seam any row that isn't rejected links to it (JN-7)."""
    want = G.formation_key(F.lit(name))
    linked = rows.where(G.formation_key(F.col("formation")) == want).where("bucket <> 'rejected' and seam is not null").select("seam").distinct().withColumn("linked", F.lit(True))
    return rows.join(linked, "seam", "left").where((G.formation_key(F.col("formation")) == want) | F.col("linked")).drop("linked")


def verified_else_provisional(rows: DataFrame) -> DataFrame:
    """Verified rows if the selection has any, else all that aren't rejected, marked as pending (WIN-5)."""
    any_ = rows.agg(F.coalesce(F.bool_or(F.col("bucket") == "verified"), F.lit(False)).alias("any_verified"))
    out = rows.where("bucket <> 'rejected'").join(F.broadcast(any_))  # one row
    return out.where(~F.col("any_verified") | (F.col("bucket") == "verified")).withColumn("pending", ~F.col("any_verified")).drop("any_verified")


def first_in_page_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    return one_per(rows, keys, ["source_page", "id"])


def resources_by_seam(rows: DataFrame) -> DataFrame:
    """The first quantity of each document's seam, in tonnes (ANA-7, WIN-4). A quantity's number is in million tonnes."""
    wanted = verified_else_provisional(rows.where(among(F.col("kind"), QUANTITY) & F.col("seam").isNotNull() & (F.col("value_num") > 0)))
    return first_in_page_order(wanted, ["document_id", "seam"]).select("document_id", "seam", "formation", F.col("value_num").alias("quantity"), (F.col("value_num") * 1e6).alias("tonnes"), "source_page", "id", "pending")


def borehole_depths(rows: DataFrame) -> DataFrame:
    """The first depth of each document's borehole, in metres (ANA-8)."""
    wanted = verified_else_provisional(rows.where("kind = 'borehole_depth' and borehole_key is not null and metres is not null"))
    return first_in_page_order(wanted, ["document_id", "borehole_key"]).select("document_id", "borehole_key", "metres", "source_page", "id", "pending")


def seam_thickness(rows: DataFrame) -> DataFrame:
    """The first thickness of each document's seam, of that kind strictly (ANA-9)."""
    wanted = verified_else_provisional(rows.where("kind = 'seam_thickness' and seam is not null and metres is not null"))
    return first_in_page_order(wanted, ["document_id", "seam"]).select("document_id", "seam", "metres", "source_page", "id", "pending")


def document_summary(rows: DataFrame) -> DataFrame:
    """Counts of each document's facts that aren't rejected (AGG-10), and of the whole corpus (AGG-17) as document ``*``."""
    count = lambda c: F.count_distinct(c)
    parts = [F.count("*").alias("facts"), count("formation").alias("formations"), count(F.when(F.col("seam_status") == "named", F.col("seam"))).alias("seams"), count("borehole_key").alias("boreholes"), F.count_if(among(F.col("kind"), QUANTITY)).alias("resource_facts"), F.count_if(F.col("bucket") == "review_required").alias("review_required"), (~F.bool_or(F.col("bucket") == "verified")).alias("pending")]
    per = rows.where("bucket <> 'rejected'").groupBy("document_id").agg(*parts)
    total = per.agg(F.lit("*").alias("document_id"), *(F.sum(c).alias(c) for c in ("facts", "formations", "seams", "boreholes", "resource_facts", "review_required")), F.bool_and("pending").alias("pending"))
    return per.unionByName(total.where("facts is not null"))


def disambiguated(documents: DataFrame) -> DataFrame:
    """Documents with a name to show: that of several files gets the id's first eight characters (AGG-11)."""
    same = F.count("*").over(Window.partitionBy(F.lower("filename")))
    return documents.withColumn("display_name", F.when(same > 1, F.concat("filename", F.lit(" ["), F.substring("document_id", 1, 8), F.lit("]"))).otherwise(F.col("filename")))


def formations(rows: DataFrame) -> DataFrame:
    """Each formation's seams, pages, documents and evidence (AGG-12)."""
    return rows.where("bucket <> 'rejected' and formation is not null").groupBy("formation").agg(
        F.array_sort(F.collect_set("seam")).alias("seams"), F.array_sort(F.collect_set("document_id")).alias("documents"), F.array_sort(F.collect_set("source_page")).alias("pages"), F.count("*").alias("evidence_count"), F.when(F.bool_or(F.col("bucket") == "verified"), "verified").otherwise("review_required").alias("bucket"))


def seams(rows: DataFrame) -> DataFrame:
    """Each document's seams with their first formation, thickness and quantity, boreholes and pages (AGG-13)."""
    order = F.struct("source_page", "id")
    first = lambda value, when: F.min_by(value, F.when(when, order))
    return rows.where("bucket <> 'rejected' and seam is not null").groupBy("document_id", "seam").agg(
        first("formation", F.col("formation").isNotNull()).alias("formation"), first("metres", (F.col("kind") == "seam_thickness") & F.col("metres").isNotNull()).alias("thickness"), first("value_num", among(F.col("kind"), QUANTITY)).alias("quantity"),
        F.array_sort(F.collect_set("borehole_key")).alias("boreholes"), F.array_sort(F.collect_set("source_page")).alias("pages"), F.count("*").alias("evidence_count"))


def boreholes(rows: DataFrame) -> DataFrame:
    """Each document's boreholes with their first depth, seams, formations and pages (AGG-14)."""
    depth = F.min_by("metres", F.when((F.col("kind") == "borehole_depth") & F.col("metres").isNotNull(), F.struct("source_page", "id")))
    return rows.where("bucket <> 'rejected' and borehole_key is not null").groupBy("document_id", "borehole_key").agg(depth.alias("depth"), F.array_sort(F.collect_set("seam")).alias("seams"), F.array_sort(F.collect_set("formation")).alias("formations"), F.count("*").alias("evidence_count"))


def filter_dimensions(rows: DataFrame) -> DataFrame:
    """The values that a browser can choose among (AGG-15, AGG-18) with their verified and provisional rows."""
    long = with_bucket(rows).unpivot(["bucket"], ["document_id", "formation", "seam", "borehole_key", "kind"], "axis", "value").where("value is not null")
    return long.groupBy("axis", "value").agg(F.count_if(F.col("bucket") == "verified").alias("verified"), F.count_if(F.col("bucket") == "review_required").alias("provisional"))


def formation_tree(rows: DataFrame) -> DataFrame:
    """Formations and their seams, from rows that name both (AGG-16)."""
    pairs = with_bucket(rows).where("formation is not null and seam is not null").groupBy("formation", "seam").agg(F.count("*").alias("n"))
    return pairs.groupBy("formation").agg(F.array_sort(F.collect_list(F.struct("seam", "n"))).alias("seams"), F.sum("n").alias("n"))


def compared_values(rows: DataFrame) -> DataFrame:
    """What each document tells in each category that documents are compared by: document_id, category, item, value."""
    base = verified_else_provisional(rows)
    none = F.lit(None).cast("double")
    entry = lambda category, item, test, value: F.when(test, F.struct(F.lit(category).alias("category"), F.col(item).alias("item"), value.alias("value")))
    kind = F.col("kind")
    told = F.array_compact(F.array(
        entry("formations", "formation", F.lit(True), none), entry("seams", "seam", F.lit(True), none), entry("boreholes", "borehole_key", F.lit(True), none), entry("resources", "seam", among(kind, QUANTITY), F.col("value_num")),
        entry("borehole_depths", "borehole_key", kind == "borehole_depth", F.col("metres")), entry("minimum_workable_thickness", "kind", kind == "minimum_workable_seam_thickness", F.col("metres"))))
    long = base.select("document_id", "source_page", "id", F.explode(told).alias("t")).select("document_id", "source_page", "id", "t.*").where("item is not null")
    return long.groupBy("document_id", "category", "item").agg(F.min_by("value", F.struct("source_page", "id")).alias("value"))


def compare_documents(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Two documents side by side (ANA-10, JN-15): each category's items, with each side's value and whether it has the item."""
    values = compared_values(rows.where(F.col("document_id").isin(a, b)))
    of = lambda d: F.col("document_id") == d
    return values.groupBy("category", "item").agg(
        F.max(F.when(of(a), F.col("value"))).alias("a_value"), F.bool_or(of(a)).alias("in_a"), F.max(F.when(of(b), F.col("value"))).alias("b_value"), F.bool_or(of(b)).alias("in_b"))


def analytics_rows(rows: DataFrame, documents: DataFrame, entity: str | None = None, metric: str | None = None) -> DataFrame:
    """Geological facts as analytics rows (ANA-6): all that aren't rejected, with the document's name as entity, the metric's label, the value to show, the
    number for a chart, what the point is called there (seam, formation, borehole or page), and the review bucket. Entities match whole; metrics by
    compatibility."""
    kept = with_bucket(rows)
    kept = kept.where(G.metrics_compatible(G.metric_kind(F.lit(metric)), F.col("kind"))) if metric else kept
    named = kept.join(documents.select("document_id", F.col("filename").alias("entity")), "document_id", "left").withColumn("entity", F.coalesce("entity", "document_id"))
    named = named.where(F.lower("entity") == entity.strip().lower()) if entity else named
    listed = F.when(F.col("kind") == "formation", F.col("formation")).when(F.col("kind") == "seam", F.col("seam")).when(F.col("kind") == "borehole", F.col("borehole_key"))
    number = F.when(~among(F.col("kind"), ("formation", "seam", "borehole")), F.coalesce("metres", "value_num"))
    point = F.coalesce("seam", "formation", "borehole_key", F.concat(F.lit("p."), F.col("source_page").cast("string")), G.metric_label(F.col("kind")))
    return named.select(
        F.col("id").alias("fact_id"), "document_id", "entity", F.col("kind").alias("metric"), G.metric_label(F.col("kind")).alias("metric_label"), F.coalesce(listed, F.col("value_num").cast("string")).alias("value"), number.alias("number"),
        F.when(number.isNotNull(), point).alias("point"), F.coalesce(F.concat(F.lit("p."), F.col("source_page").cast("string")), F.lit("—")).alias("period"), "seam", "formation", F.col("borehole_key").alias("borehole"), F.col("source_page").alias("page"), "status", "bucket")


def explorer_overview(rows: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """The explorer's parts over one selection (ANA-15): facts, filters, roll-ups, and the analytics of each kind. The selection is made, and its names are read, once."""
    rows = stored(rows.select("id", "document_id", "kind", "bucket", "seam", "seam_status", "formation", "borehole_key", "metres", "value_num", "source_page", "status"), "explorer")
    return {
        "facts": analytics_rows(rows, documents), "filters": filter_dimensions(rows), "summary": document_summary(rows), "formations": formations(rows), "seams": seams(rows), "boreholes": boreholes(rows), "tree": formation_tree(rows),
        "resources": resources_by_seam(rows), "depths": borehole_depths(rows), "thickness": seam_thickness(rows),
    }


def overview_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """How many rows each part of the explorer has."""
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def locations(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The first coordinate of each document: from its facts' evidence in page order, else from its metadata text (ANA-14)."""
    found = rows.withColumn("p", G.latitude_longitude(F.col("evidence_text"))).where("p is not null")
    facts = one_per(found, ["document_id"], ["source_page", "id"]).select("document_id", F.col("p").alias("from_facts"))
    return documents.join(facts, "document_id", "left").withColumn("p", F.coalesce("from_facts", G.latitude_longitude(F.col("meta_text")))).where("p is not null").select("document_id", "p.latitude", "p.longitude")
