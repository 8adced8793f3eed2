"""Analytic queries over verified facts: trend, actual against target, comparison, dimensions and overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import blank_as_null, strip
from lodestone.operators.facts import HASH, best, by_hash, merged, normalized, of_latest, one_per, verified, without_open_conflicts

CORE = ("production", "coal", "overburden", "dispatch", "lignite")


def usable(facts: DataFrame, documents: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Verified facts of the latest file versions, normalised, without those of open conflicts."""
    return without_open_conflicts(normalized(of_latest(verified(facts), documents)), conflicts)


def trend(facts: DataFrame) -> DataFrame:
    """The best fact of each entity, field and period, with the line or bar that its series makes (ANA-1, ANA-13)."""
    points = best(facts.where("entity is not null and period is not null"), ["entity", "field", "period"])
    series = Window.partitionBy("entity", "field")
    return points.withColumn("chart_type", F.when(F.count("*").over(series) >= 2, "line").otherwise("bar"))


def merged_trend(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The trend over index facts and verified facts alike (ANA-1): classified rows merged; where an entity's metric has index facts, rows measured during
    the period alone, if it has any; without the periods of open conflicts; the most trusted of each entity, metric and period, the later one of equals."""
    known = merged(rows).where("value is not null and period is not null").withColumn("entity", N.entity(F.col("entity_name"))).where("entity is not null")
    series = Window.partitionBy("entity", "storage_metric")
    during = F.coalesce(F.col("measure") == "during", F.lit(False))
    kept = known.withColumns({"indexed": F.max(F.col("source") == "index").over(series), "has_during": F.max(during).over(series)}).where(~F.col("indexed") | ~F.col("has_during") | during)
    free = without_open_conflicts(kept.withColumn("field", F.col("storage_metric")), conflicts)
    return best(free, ["entity", "storage_metric", "period"], "confidence", "fact_id").select("entity", "storage_metric", "period", "measure", "value", "unit", "fact_id", "source", "document_id")


def actual_vs_target_merged(rows: DataFrame, facts: DataFrame, metrics: tuple[str, ...] = ("production", "coal", "lignite")) -> DataFrame:
    """Actual and target (ANA-2): of each entity and period the pair that index facts of one metric give, of the first of ``metrics`` that has both; else
    the pair of production and its target among the usable facts. ``path`` tells which."""
    index = rows.where((F.col("source") == "index") & F.col("measure").isin("during", "target") & F.col("storage_metric").isin(*metrics) & F.col("value").isNotNull() & F.col("period").isNotNull())
    order = F.struct("confidence", "fact_id")
    side = lambda m: (F.max_by("value", F.when(F.col("measure") == m, order)), F.max_by("fact_id", F.when(F.col("measure") == m, order)))
    (actual, actual_id), (target, target_id) = side("during"), side("target")
    pairs = index.groupBy(N.entity(F.col("entity_name")).alias("entity"), "storage_metric", "period").agg(actual.alias("actual"), target.alias("target"), actual_id.alias("actual_id"), target_id.alias("target_id")).where("actual is not null and target is not null")
    rank = F.array_position(F.array(*map(F.lit, metrics)), F.col("storage_metric"))
    columns = ["entity", "period", "actual", "target", "actual_id", "target_id"]
    sides = pairs.select(*columns, F.lit("index").alias("path"), rank.cast("int").alias("rank"))
    named = actual_vs_target(facts).select(*columns, F.lit("fields").alias("path"), F.lit(len(metrics) + 1).alias("rank"))
    both = one_per(sides.unionByName(named), ["entity", "period"], ["rank"]).drop("rank")  # index facts are read once
    return both.withColumn("achievement", F.round(F.col("actual") / F.nullif(F.col("target"), F.lit(0.0)) * 100, 2))


def _sides(facts: DataFrame, actual: str, target: str) -> DataFrame:
    """entity, period and the best fact of each of two fields (structs a and t, null where there is none), ranked once."""
    points = best(facts.where(F.col("field").isin(actual, target) & F.col("entity").isNotNull() & F.col("period").isNotNull()), ["entity", "field", "period"])
    side = lambda name: F.max(F.when(F.col("field") == name, F.struct("numeric_value", "base_value", "unit", "id")))
    return points.groupBy("entity", "period").agg(side(actual).alias("a"), side(target).alias("t"))


def _achievement() -> Column:
    return F.round(F.col("actual") / F.nullif(F.col("target"), F.lit(0.0)) * 100, 2)


def actual_vs_target(facts: DataFrame, actual: str = "production", target: str = "production_target") -> DataFrame:
    """Actual and target of each entity and period that has both, with the achievement in percent (ANA-2, JN-5). Nothing of
    an entity's period is compared unless both sides are free of conflicts."""
    both = _sides(facts, actual, target).where("a is not null and t is not null and a.id <> t.id")
    columns = [F.col(f"{side}.{c}").alias(f"{tag}{name}") for side, tag in (("a", "actual"), ("t", "target")) for c, name in (("numeric_value", ""), ("base_value", "_base"), ("unit", "_unit"), ("id", "_id"))]
    return both.select("entity", "period", *columns).withColumn("achievement", _achievement())


def compare_entities(facts: DataFrame, field: str = "production") -> DataFrame:
    """Each entity's fact of its newest period (ANA-3, WIN-3); ``withheld`` where the entities' units differ."""
    rows = facts.where((F.col("field") == field) & F.col("period").isNotNull())
    bars = one_per(rows, ["entity"], [F.desc("period"), F.desc("confidence_score"), F.desc("id")])
    units = bars.agg((F.count_distinct(F.lower(F.coalesce("unit", F.lit("")))) > 1).alias("withheld"))
    return bars.join(F.broadcast(units), how="left")  # one row


def period_table(facts: DataFrame) -> DataFrame:
    """Every period of an entity's production trend or actual/target pair (ANA-4, JN-6)."""
    rows = _sides(facts, "production", "production_target").where("a is not null")
    paired = F.col("t").isNotNull() & (F.col("a.id") != F.col("t.id"))
    out = rows.select("entity", "period", F.col("a.numeric_value").alias("trend_value"), F.when(paired, F.col("a.numeric_value")).alias("actual"), F.when(paired, F.col("t.numeric_value")).alias("target"))
    return out.withColumn("achievement", _achievement())


def overview(facts: DataFrame) -> DataFrame:
    """Counts and mean confidence of the verified facts (AGG-5)."""
    rows = normalized(verified(facts))
    return rows.agg(F.count("*").alias("verified_facts"), F.count_distinct("entity").alias("entities"), F.count_distinct("field").alias("metrics"), F.round(F.avg("confidence_score"), 3).alias("mean_confidence"))


def top_entities(facts: DataFrame, n: int = 8) -> DataFrame:
    """The entities with the largest production, with their numbers of facts (AGG-6)."""
    rows = normalized(verified(facts)).where("field = 'production' and base_value is not null")
    return rows.groupBy("entity").agg(F.sum("base_value").alias("total"), F.count("*").alias("fact_count")).orderBy(F.desc("total"), "entity").limit(n)


def by_commodity(rows: DataFrame) -> DataFrame:
    """Totals of the classified rows by stored metric and unit (AGG-7)."""
    return rows.where(F.col("storage_metric").isin(*CORE)).groupBy("storage_metric", "unit").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def confidence_histogram(facts: DataFrame) -> DataFrame:
    """Numbers of verified facts by confidence; every bucket has a row (AGG-8)."""
    c = F.col("confidence_score")
    bucket = F.when(c >= 0.9, "0.9-1.0").when(c >= 0.8, "0.8-0.9").when(c >= 0.7, "0.7-0.8").otherwise("below 0.7")
    wide = verified(facts).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    names = facts.sparkSession.createDataFrame([("0.9-1.0",), ("0.8-0.9",), ("0.7-0.8",), ("below 0.7",)], "bucket string")
    return names.join(wide, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_uploads(documents: DataFrame) -> DataFrame:
    """Numbers of documents by month and status (AGG-9)."""
    return documents.groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("n"))


def dimensions(rows: DataFrame) -> DataFrame:
    """The distinct values of each axis of the classified rows (AGG-1, AGG-2, AGG-3) as rows (axis, value)."""
    axes = ["entity_name", "commodity", "metric", "measure", "period", "reporting_month"]
    return rows.unpivot([], axes, "axis", "value").where("value is not null").distinct()


#: Storage metrics that are offered as metrics too, and the metrics that are suggested first, in order.
LEGACY_METRICS = ("coal", "lignite", "coking_coal", "production_target")
SUGGESTED_METRICS = ("production", "overburden", "dispatch")


def facets(rows: DataFrame, entity: str | None = None, commodity: str | None = None, metric: str | None = None) -> DataFrame:
    """The values of each axis under criteria (AGG-1, dependent filters), from one aggregate: axis, value, n (rows that meet all criteria), n_open (rows that fail none but
    the axis's own), score (entities: three points for a core metric, one for others) and listed (whether the axis offers the value: entities and legacy
    metrics always, others if n > 0).

    Each row carries a mask of the criteria that it fails, so that it is read and shuffled once for all axes, however many criteria there are. A criterion that is
    None or blank asks for nothing; a metric may also name a storage metric. Null values are no values; an empty table has no facets."""
    same = lambda test: F.coalesce(test, F.lit(False))
    key = blank_as_null(strip(F.lit(metric).cast("string")))
    want = F.coalesce(N.field(key), F.lower(key))
    tests = {
        1: blank_as_null(strip(F.lit(entity).cast("string"))).isNull() | same(F.lower("entity_name") == F.lower(strip(F.lit(entity).cast("string")))),
        2: N.commodity(F.lit(commodity).cast("string")).isNull() | same(F.col("commodity") == N.commodity(F.lit(commodity).cast("string"))),
        4: want.isNull() | same(F.col("metric") == want) | same(F.col("storage_metric") == want),
    }
    fails = sum((F.when(test, 0).otherwise(bit) for bit, test in tests.items()), F.lit(0))
    own = {"entity_name": 1, "commodity": 2, "metric": 4, "legacy_metric": 4, "measure": 0, "period": 0, "reporting_month": 0}
    legacy = F.when(F.col("storage_metric").isin(*LEGACY_METRICS), F.col("storage_metric"))
    wide = rows.withColumns({"legacy_metric": legacy, "fails": fails, "points": F.when(F.col("storage_metric").isin(*CORE), 3).otherwise(1)})
    long = wide.unpivot(["fails", "points"], list(own), "axis", "value").where("value is not null")
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in own.items() for x in pair)), F.col("axis"))
    out = long.groupBy("axis", "value").agg(F.count_if(F.col("fails") == 0).alias("n"), F.count_if(F.col("fails").bitwiseAND(7 - bit) == 0).alias("n_open"), F.sum("points").alias("points"))
    always = F.col("axis").isin("entity_name", "legacy_metric")
    return out.select("axis", "value", "n", "n_open", F.when(F.col("axis") == "entity_name", F.col("points")).alias("score"), (always | (F.col("n") > 0)).alias("listed"))


def suggested(found: DataFrame) -> DataFrame:
    """One row: the entity, metric, commodity and month that facets suggest (AGG-1): the best covered entity (shorter, then smaller names first), the first of the preferred
    metrics, coal, the first March; else the smallest, and for months none."""
    at = lambda axis, test=True: F.when((F.col("axis") == axis) & F.col("listed") & test, F.col("value"))
    metrics = [F.max(at("metric", F.col("value") == m)) for m in SUGGESTED_METRICS]
    entity = F.min_by(at("entity_name"), F.when(at("entity_name").isNotNull(), F.struct(-F.col("score"), F.length("value"), "value")))
    month = F.min_by(at("reporting_month"), F.when(at("reporting_month", F.lower("value").contains("march")).isNotNull(), F.struct(F.lower("value"), "value")))
    return found.agg(entity.alias("entity"), F.coalesce(*metrics, F.min(at("metric"))).alias("metric"), F.coalesce(F.max(at("commodity", F.col("value") == "coal")), F.min(at("commodity"))).alias("commodity"), month.alias("reporting_month"))


def entity_scores(rows: DataFrame) -> DataFrame:
    """How well each entity is covered: three points for a core metric, one for others (AGG-1)."""
    return rows.groupBy("entity_name").agg(F.sum(F.when(F.col("storage_metric").isin(*CORE), 3).otherwise(1)).alias("score"))


def document_counts(documents: DataFrame, production: DataFrame, geological: DataFrame) -> DataFrame:
    """Production and geological facts of each document, and its domain (AGG-4, FLT-7)."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    out = documents.select("document_id", "filename").join(count(production, "production_facts"), "document_id", "left").join(count(geological, "geological_facts"), "document_id", "left").na.fill(0)
    return out.withColumn("domain", domain(F.col("geological_facts"), F.col("production_facts"))).withColumn("has_data", F.col("production_facts") + F.col("geological_facts") > 0)


def domain(geological: F.Column, production: F.Column) -> F.Column:
    return F.when((geological > 0) & (production == 0), "geological").when((geological > 0) & (production > 0), "mixed").otherwise("production")


def dashboard(documents: DataFrame) -> DataFrame:
    """Numbers of documents by state of work (AGG-24)."""
    of = lambda s: F.count_if(F.col("status") == s)
    return documents.agg(F.count("*").alias("total"), of("UPLOADED").alias("pending"), of("PROCESSING").alias("processing"), of("COMPLETED").alias("completed"))


def newest(documents: DataFrame, n: int = 5) -> DataFrame:
    """The newest documents (AGG-24)."""
    return documents.orderBy(F.desc("created_at"), F.desc("document_id")).limit(n)


def status_counts(**parts: DataFrame) -> DataFrame:
    """Numbers of rows by name (AGG-25)."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def common_year(facts: DataFrame) -> DataFrame:
    """For each field the latest period that every entity of the field has (WIN-12)."""
    per = facts.groupBy("field", "period").agg(F.count_distinct("entity").alias("n"))
    every = facts.groupBy("field").agg(F.count_distinct("entity").alias("n"))
    return per.join(every, ["field", "n"]).groupBy("field").agg(F.max("period").alias("period"))


def year_changes(facts: DataFrame) -> DataFrame:
    """Each point of the trend with its change since the period before it (ANA-11, FN-32)."""
    w = Window.partitionBy("entity", "field").orderBy("period")
    rows = trend(facts).withColumn("before", F.lag("base_value").over(w))
    return rows.withColumn("change", F.col("base_value") - F.col("before")).withColumn("percent", F.round(N.percentage_change(F.col("base_value"), F.col("before"))["value"], 2))


def unique_facts(rows: DataFrame) -> DataFrame:
    """Facts by dimension: ``conflict`` where their values differ, else one value and its number of facts (ANA-12, VAL-9)."""
    keys = ["entity_name", "storage_metric", "period", "measure", "reporting_month", "unit"]
    return by_hash(rows, keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("fact_id", F.struct("document_id", "fact_id")).alias("fact_id")).drop(HASH).withColumn("conflict", F.col("high") - F.col("low") > 1e-6)
