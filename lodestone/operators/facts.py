"""Facts: scanning, normalising, merging, versioning and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import among, blank_as_null, strip

OPEN = ("review_required", "detected", "confirmed")


def one_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each group. ``order`` must be total, so that reruns agree."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_of(df: DataFrame, keys: list, order: list, n: int, what: list, name: str) -> DataFrame:
    """Each group's first ``n`` rows as an array ``name`` of structs of ``what``, with their ``place`` from 1: rows are ranked, and all but the first n left out, before lists are made, so that
    no list outgrows n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", *what))).alias(name))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often they are read. Spark copies a projection's expressions into the filters and projections above it, and what is
    copied at several levels outgrows a generated method (64 KB), so that the rows are interpreted; it copies nothing out of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


#: A hash of group keys that stands before them.
HASH = "_hash"


def by_hash(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """Rows grouped by keys and, first, a hash of them (HASH, to be dropped): where groups are made by sorting, as for the least text or struct of each, numbers are compared and not several texts."""
    return df.withColumn(HASH, F.xxhash64(*keys)).groupBy(HASH, *keys)


def normalized(facts: DataFrame) -> DataFrame:
    """Adds entity, field, period, unit_norm and base_value."""
    keyed = once(facts, _entity=N.entity_key(F.col("entity_name")), _field=N.field_key(F.col("field_name")), _period=N.period_key(F.col("financial_year")), _unit=N.unit_key(F.col("unit")))
    out = keyed.withColumns({"entity": blank_as_null(F.col("_entity")), "field": N.field_of(F.col("_field")), "period": N.period_of(F.col("_period")), "unit_norm": N.unit_of(F.col("_unit"))})
    return out.withColumn("base_value", N.base_value(F.col("numeric_value"), F.col("unit_norm"))).drop("_entity", "_field", "_period", "_unit")


def verified(facts: DataFrame) -> DataFrame:
    """Verified, reported, numeric facts (FLT-2)."""
    return facts.where(among(F.col("status"), N.VERIFIED) & ~F.coalesce("is_calculated", F.lit(False)) & F.col("numeric_value").isNotNull())


def latest_versions(documents: DataFrame) -> DataFrame:
    """The newest version of each file, by name without regard to case (JN-2, WIN-6)."""
    return one_per(documents, [F.lower("filename")], [F.desc("version"), F.desc("document_id")])


def of_latest(facts: DataFrame, documents: DataFrame) -> DataFrame:
    return facts.join(latest_versions(documents).select("document_id"), "document_id", "left_semi")


def with_document(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with their document's name and version (JN-1); those of unknown documents show the id as name."""
    found = facts.join(documents.select("document_id", F.col("filename").alias("document_name"), F.col("version").alias("document_version")), "document_id", "left")
    return found.withColumn("document_name", F.coalesce("document_name", "document_id"))


def index_facts(chunks: DataFrame) -> DataFrame:
    """Chunk metadata (a JSON text ``meta``) as typed facts (SRC-2, SRC-3): active structured chunks whose value is a
    number and whose entity and metric aren't empty. Confidence is 0.9 where none is given."""
    keys = ["entity", "metric", "reporting_month", "fiscal_year", "measurement_type", "value", "unit", "confidence", "page"]
    read = chunks.where("is_active and content_type = 'structured_fact'").select("chunk_id", "document_id", F.json_tuple("meta", *keys).alias(*keys))  # one pass over each text
    keyed = once(
        read.withColumnsRenamed({"value": "value_text", "unit": "unit_text"}), entity_name=strip(F.col("entity")), _metric=N.field_key(F.col("metric")), _month=strip(F.col("reporting_month")), _period=N.period_key(F.col("fiscal_year")), _measure=N.measurement_key(F.col("measurement_type")),
        value=F.col("value_text").try_cast("double"), unit=strip(F.col("unit_text")))
    out = keyed.select(
        "chunk_id", "document_id", "entity_name", N.field_of(F.col("_metric")).alias("metric"), blank_as_null(F.col("_month")).alias("reporting_month"), N.period_of(F.col("_period")).alias("period"),
        blank_as_null(F.col("_measure")).alias("measure"), "value", "unit", F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.9)).alias("confidence"), F.col("page").try_cast("double").try_cast("int").alias("page"),
    )
    return out.where("value is not null and entity_name <> '' and metric <> ''")


def filter_index_facts(facts: DataFrame, entity: str | None = None, metric: str | None = None, period: str | None = None, month: str | None = None, measure: str | None = None) -> DataFrame:
    """Facts that answer a selection (FLT-1); a criterion that is None doesn't restrict."""
    tests = [
        (entity, lambda: N.soft_match(F.lit(entity), F.col("entity_name"))), (metric, lambda: F.col("metric") == N.field(F.lit(metric))), (period, lambda: F.col("period") == N.period(F.lit(period))),
        (month, lambda: F.lower("reporting_month") == month.strip().lower()), (measure, lambda: F.col("measure") == N.measure(F.lit(measure))),
    ]
    for given, test in tests:
        facts = facts.where(test()) if given is not None else facts
    return facts


def classified(index: DataFrame, facts: DataFrame) -> DataFrame:
    """Index facts and verified facts with commodity, metric and measure as axes of their own (SET-1)."""

    def shape(df: DataFrame, metric: str, measure: Column | None, year: Column | None, cols: list) -> DataFrame:
        keys = {"_name": strip(F.col("entity_name")), "_metric": N.field_key(F.col(metric)), "_measure": N.measurement_key(measure)}
        rows = once(df, **keys, **({} if year is None else {"_period": N.period_key(year)})).where(N.plausible(F.col("_name"))).withColumn("_raw", N.field_of(F.col("_metric")))
        return rows.withColumn("c", N.classify(F.col("_raw"), F.col("_measure"))).select("c.*", *cols)

    a = shape(index, "metric", F.col("measure"), None, ["document_id", "entity_name", "period", "reporting_month", "value", "unit", "confidence", F.col("chunk_id").alias("fact_id"), F.lit("index").alias("source")])
    b = shape(verified(facts), "field_name", None, F.col("financial_year"), ["document_id", "entity_name", N.period_of(F.col("_period")).alias("period"), F.lit(None).cast("string").alias("reporting_month"), F.col("numeric_value").alias("value"), "unit", F.col("confidence_score").alias("confidence"), F.col("id").alias("fact_id"), F.lit("extracted").alias("source")])
    return a.unionByName(b)


def merged(rows: DataFrame) -> DataFrame:
    """One row for each (entity, storage metric, period, value, measure), index facts first (WIN-1)."""
    keys = [F.lower("entity_name"), "storage_metric", "period", F.round("value", 6), F.coalesce("measure", F.lit(""))]
    return one_per(rows, [F.xxhash64(*keys), *keys], [F.when(F.col("source") == "index", 0).otherwise(1), "fact_id"])


def best(facts: DataFrame, keys: list[str], confidence: str = "confidence_score", id_: str = "id") -> DataFrame:
    """The row of highest confidence in each group, the later one of equals (WIN-2)."""
    return one_per(facts, keys, [F.desc(confidence), F.desc(id_)])


def without_open_conflicts(facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Normalised facts whose (entity, field, period) has no open conflict (JN-8). A conflict without a period counts for all periods."""
    open_ = conflicts.where(among(F.col("status"), OPEN)).select(N.entity(F.col("entity_name")).alias("entity"), N.field(F.col("field_name")).alias("field"), N.period(F.col("period")).alias("period"))
    dated, undated = open_.where("period is not null").distinct(), open_.where("period is null").select("entity", "field").distinct()
    return facts.join(dated, ["entity", "field", "period"], "left_anti").join(undated, ["entity", "field"], "left_anti")


def contains_ci(column: str | Column, text: str) -> Column:
    """Whether a column holds a text, without regard to case; the text is taken literally."""
    return F.contains(F.lower(F.col(column) if isinstance(column, str) else column), F.lower(F.lit(text)))
