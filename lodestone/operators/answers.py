"""Answers from facts alone: facts that satisfy query specs, bars of entities, tables of periods with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import among, blank_as_null, strip
from lodestone.operators.facts import OPEN, once
from lodestone.operators.reason import PRODUCTION, TEXTS, given, names_that_answer
from lodestone.operators.retrieve import significant_words

# What a fact is worth before and for each criterion that it meets, and what its place in an answer starts from, with and without a period.
COMPATIBLE = 1.2
TERMS = {"entity": 0.35, "metrics": 0.25, "periods": 0.2, "months": 0.25, "measures": 0.15}
REASONS = {"entity": "entity_match", "metrics": "metric_match", "periods": "period_match", "months": "reporting_month_match", "measures": "measure_type_match"}
DATED, UNDATED, SHARE = 0.92, 0.9, 0.01

# How a table's title speaks for the metric asked for ("" for any): words it must hold, words it must not hold, words of which it must hold one, and the weight.
TITLES = (
    ("coal", ("coal", "production"), (), (), 0.45),
    ("coal", ("coal",), ("production",), (), 0.2),
    ("coal", ("status",), ("coal",), (), -0.3),
    ("coal", (), (), ("dispatch", "supply", "washed", "coking"), -0.35),
    ("lignite", ("lignite",), (), (), 0.45),
)
NUMBERED, NUMBERED_WEIGHT = r"table\s+\d", 0.1
UNITS_ONLY, UNITS_WEIGHT = r"^all figures|fig\. in", -0.2

#: Metrics that don't answer a question about coal, though their names may hold it.
NOT_COAL = ("lignite", "coking_coal")


def title_relevance(title: Column, metrics: Column) -> Column:
    """How much a table's title speaks for the metrics asked for (an array in lower case): the sum of its rules' weights; 0 without a title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    every = lambda words: [F.contains(low, F.lit(w)) for w in words]
    score = F.when(low.rlike(NUMBERED), NUMBERED_WEIGHT).otherwise(0.0) + F.when(low.rlike(UNITS_ONLY), UNITS_WEIGHT).otherwise(0.0)
    for metric, needs, lacks, either, weight in TITLES:
        test = F.array_contains(metrics, metric)
        for one in every(needs):
            test = test & one
        for one in every(lacks):
            test = test & ~one
        if either:
            test = test & F.exists(F.array(*map(F.lit, either)), lambda w: F.contains(low, w))
        score = score + F.when(test, weight).otherwise(0.0)
    return F.round(score, 6)


def metrics_that_answer(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs (metric, f_metric) of an asked metric and a stored one that holds its name, underscores as blanks; production is answered by any commodity too. Stored names are
    cut into their parts of the lengths asked for, so that they meet by equal keys."""
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    lengths = asked.agg(F.collect_set(F.length("metric")).alias("lengths"))  # one row, of as many numbers as names have lengths
    cut = F.flatten(F.transform("lengths", lambda n: F.when(n <= F.length("name"), F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n))).otherwise(F.array().cast(TEXTS))))
    parts = stored.select("f_metric", words("f_metric").alias("name")).join(F.broadcast(lengths)).select("f_metric", F.explode(F.array_distinct(cut)).alias("part"))
    held = asked.select("metric", words("metric").alias("part")).join(parts, "part").select("metric", "f_metric")
    wide = asked.where("metric = 'production'").join(stored.where(among(F.col("f_metric"), PRODUCTION)))  # at most one name and three
    return held.unionByName(wide.select("metric", "f_metric")).distinct()


def _reach(specs: DataFrame, keyed: DataFrame) -> DataFrame:
    """What each spec reaches: spec_id, f_entity and f_metric, an empty text for any. A name is met by its letters and digits, or by all its significant words where the stored name
    has no more of them, so that a part of a longer name doesn't take its facts."""
    letters = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", "")
    asked, names = specs.where("entity is not null").select("entity").distinct(), keyed.select("f_entity").distinct()
    near = names_that_answer(asked, names).where(F.size(F.array_distinct(significant_words(F.col("f_entity")))) <= F.size(F.array_distinct(significant_words(F.col("entity")))))
    same = asked.withColumn("key", letters("entity")).where("key <> ''").join(names.withColumn("key", letters("f_entity")), "key").select("entity", "f_entity")
    entities = specs.select("spec_id", "entity").join(near.unionByName(same).distinct(), "entity", "left")
    entities = entities.where("entity is null or f_entity is not null").select("spec_id", F.coalesce("f_entity", F.lit("")).alias("f_entity"))
    wanted = specs.select("spec_id", F.array_contains("metrics", "coal").alias("coal"), F.explode_outer("metrics").alias("metric"))
    pairs = metrics_that_answer(wanted.select("metric").where("metric is not null").distinct(), keyed.select("f_metric").distinct())
    metrics = wanted.join(pairs, "metric", "left").where("metric is null or f_metric is not null").where(~(F.coalesce("coal", F.lit(False)) & among(F.col("f_metric"), NOT_COAL)))
    metrics = metrics.select("spec_id", F.coalesce("f_metric", F.lit("")).alias("f_metric")).distinct()
    return entities.join(metrics, "spec_id").where("f_entity <> '' or f_metric <> ''")


def fact_first(facts: DataFrame, specs: DataFrame, k: int = 40) -> DataFrame:
    """The ``k`` best facts of each spec that asks for a number (RET-6, FLT-8): spec_id, fact_id, document_id, period asked for, score, compat, reasons, rank.

    Specs: spec_id, entity, prefers_numeric, the arrays metrics, periods, months, measures (null or empty: not asked). A fact must meet every criterion that is asked: the entity by name,
    one of the metrics (coal is neither lignite nor coking coal), one of the periods in any of its spellings, one of the months and measures. Facts: fact_id, document_id, entity_name, metric,
    reporting_month, period, measure, table_title. ``compat`` adds up what is met and the title's relevance; the score is 0.92 (0.90 without a period), a hundredth of what is met, and the
    title's relevance. The best are those whose score and compat add up to most; ties go by fact_id. A spec that names neither entity nor metric reaches nothing; facts without a name take no part; repeated
    facts count once.

    Specs and facts meet by (name, metric), (name) or (metric) alone, whichever the spec gives, after names and metrics have met in their distinct forms; ranks are pruned before the shuffle."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    plain = lambda c: F.lower(F.replace(c, F.lit(" ")))
    lowered = lambda c: F.array_distinct(F.transform(given(c), F.lower))
    s = specs.where(F.coalesce("prefers_numeric", F.lit(False))).select("spec_id", blank_as_null(strip(F.col("entity"))).alias("entity"), lowered("metrics").alias("metrics"), given("periods").alias("periods"), lowered("months").alias("months"), lowered("measures").alias("measures"))
    spelled = F.transform("periods", lambda p: F.struct(p.alias("period"), F.array_append(F.transform(N.period_forms(p), plain), plain(p)).alias("forms")))
    s = s.withColumn("spelled", spelled)
    keyed = facts.withColumns({"f_entity": low("entity_name"), "f_metric": low("metric")}).where("f_entity <> '' and f_metric <> ''")
    blank = F.lit("").alias
    keys = F.array(F.struct("f_entity", "f_metric"), F.struct("f_entity", blank("f_metric")), F.struct(blank("f_entity"), "f_metric"))
    columns = ["fact_id", "document_id", "reporting_month", "period", "measure", "table_title"]
    offered = keyed.select(*columns, F.explode(keys).alias("at")).select(*columns, "at.*")
    met = _reach(s, keyed).join(s, "spec_id").join(offered.withColumnRenamed("period", "f_period"), ["f_entity", "f_metric"])
    period = F.get(F.filter("spelled", lambda x: F.array_contains(x["forms"], plain(F.col("f_period")))), 0)["period"]
    free = lambda c: F.size(c) == 0
    fits = (free("periods") | F.col("matched").isNotNull()) & (free("months") | F.array_contains("months", low("reporting_month"))) & (free("measures") | F.array_contains("measures", low("measure")))
    asks = {c: F.col(c).isNotNull() if c == "entity" else ~free(c) for c in TERMS}
    compat = sum((F.when(asks[c], x).otherwise(0.0) for c, x in TERMS.items()), F.lit(COMPATIBLE))
    title = F.col("title")
    score = F.when(free("periods"), UNDATED).otherwise(DATED) + SHARE * F.col("met") + title
    reasons = F.array_compact(F.array(*(F.when(asks[c], REASONS[c]) for c in TERMS), F.when(title > 0, "title_relevance")))
    hits = met.withColumn("matched", period).where(fits).withColumns({"met": F.round(compat, 6), "title": title_relevance(F.col("table_title"), F.col("metrics"))})
    hits = hits.select("spec_id", "fact_id", "document_id", F.col("matched").alias("period"), F.round(score, 6).alias("score"), F.round(F.col("met") + title, 6).alias("compat"), reasons.alias("reasons")).distinct()
    best = Window.partitionBy("spec_id").orderBy(F.desc(F.round(F.col("score") + F.col("compat"), 6)), "fact_id", "document_id", "period")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def entity_bars(rows: DataFrame, conflicts: DataFrame, entities: DataFrame, metric: str = "production") -> DataFrame:
    """One bar for each asked entity (ANA-3): entity, status, value, unit, period, fact_id, document_id.

    Of an entity's classified rows of the metric those measured during the period come first (extracted facts count as such), then the latest period, then confidence, then the larger fact_id: one
    aggregate. ``conflict``: the metric has an open conflict in any period, so that it is left out; ``missing``: it has no value; ``withheld``: the units of the bars differ, so that none is shown; else ``ok``. Names are
    told apart without regard to case; null names are none."""
    key = N.field(F.lit(metric))
    during = (F.col("source") != "index") | F.coalesce(F.col("measure") == "during", F.lit(False))
    order = F.struct(during.alias("during"), F.coalesce("period", F.lit("")).alias("period"), F.col("confidence"), F.col("fact_id"))
    best = rows.where((F.col("storage_metric") == key) & F.col("value").isNotNull()).groupBy(N.entity(F.col("entity_name")).alias("entity")).agg(F.max_by(F.struct("value", "unit", "period", "fact_id", "document_id"), order).alias("bar"))
    asked = once(entities.select("entity_name").distinct(), entity=N.entity(F.col("entity_name"))).where("entity is not null").select("entity").distinct()  # each name is read once
    open_ = conflicts.where(among(F.col("status"), OPEN) & (N.field(F.col("field_name")) == key)).select(N.entity(F.col("entity_name")).alias("entity"), F.lit(True).alias("open")).distinct()
    state = F.when(F.coalesce("open", F.lit(False)), "conflict").when(F.col("bar").isNull(), "missing").otherwise("ok")
    bars = asked.join(best, "entity", "left").join(open_, "entity", "left").withColumn("status", state)
    units = bars.where("status = 'ok' and bar.unit <> ''").agg((F.count_distinct(F.lower("bar.unit")) > 1).alias("mixed"))
    shown = bars.join(F.broadcast(units)).withColumn("status", F.when(F.col("mixed") & (F.col("status") == "ok"), "withheld").otherwise(F.col("status")))  # one row
    return shown.select("entity", "status", *(F.when(F.col("status") == "ok", F.col(f"bar.{c}")).alias(c) for c in ("value", "unit", "period", "fact_id", "document_id")))


#: What stands beside a value whose origin is unknown.
NO_EVIDENCE = "Evidence unavailable for this value."


def evidence_table(points: DataFrame, pairs: DataFrame, origins: DataFrame, documents: DataFrame) -> DataFrame:
    """The periods of each entity with actual, target and evidence (ANA-4, JN-6): entity, period, actual, target, achievement, unit, fact_id, document_id, source, page, note.

    ``points``: the trend of one metric (entity, period, value, unit, fact_id); ``pairs``: actual and target (entity, period, actual, target, achievement, actual_id), whose actual value takes the place of the
    trend's. Periods of either appear. ``origins``: fact_id, document_id, unit, page of facts, each once; evidence is the trend's fact, else the pair's. A value whose fact is unknown says so in ``note``; a document without name has a null source."""
    p = points.select("entity", "period", "value", F.col("unit").alias("point_unit"), F.col("fact_id").alias("point_id"))
    both = p.join(pairs.select("entity", "period", "actual", "target", "achievement", "actual_id"), ["entity", "period"], "full_outer")
    both = both.withColumns({"fact_id": F.coalesce("point_id", "actual_id"), "actual": F.coalesce("actual", "value")})
    told = both.join(origins.select("fact_id", "document_id", "unit", "page"), "fact_id", "left").join(documents.select("document_id", F.col("filename").alias("source")), "document_id", "left")
    note = F.when(F.col("fact_id").isNull() & F.col("document_id").isNull(), NO_EVIDENCE)
    return told.select("entity", "period", "actual", "target", "achievement", F.coalesce("point_unit", "unit").alias("unit"), "fact_id", "document_id", "source", "page", note.alias("note"))
