"""Several facts in one answer: the slots that a comparison needs, one value for each, and the verdict on them; evidence packs; document scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions.text import among
from lodestone.operators.facts import HASH, by_hash, first_of, once, one_per
from lodestone.operators.retrieve import route, significant_words
from lodestone.sources.cut import ensure_checkpoints

# Ways of comparing that ask for a year's value each, and the metrics that a question about coal or production accepts.
YEARLY = ("change", "rank", "compare")
COAL = ("coal", "coal_production")
PRODUCTION = ("coal", "lignite", "coking_coal")

TOLERANCE = 1e-6
TEXTS = "array<string>"


def given(name: str) -> Column:
    """An array's values, each once, without nulls; none for a null array."""
    return F.array_distinct(F.array_compact(F.coalesce(F.col(name), F.array().cast(TEXTS))))


def required_slots(specs: DataFrame) -> DataFrame:
    """The slots that each spec needs (JN-13): one for each entity, period, month, measure and metric, in this order, numbered from 0.

    Specs: spec_id, the arrays entities, metrics, months, periods, measures (null or empty: not asked), and mode (change, rank, compare or null).
    Without a measure the actual value is asked; ``production`` gives way to a metric that says more. A null month or period of a slot stands for any. A spec of one entity that
    compares without a period needs what nobody can name, so it has no slots, nor has one without entity or metric. ``aligned``: several entities without a period,
    whose latest common year is to be found. Nulls in arrays and repeated values are left out."""
    s = specs.select("spec_id", *(given(c).alias(c) for c in ("entities", "metrics", "months", "periods", "measures")), F.lower("mode").alias("mode"))
    any_ = F.array(F.lit(None).cast("string"))
    certain = F.filter("metrics", lambda m: F.lower(m) != "production")
    periods = F.when(F.size("periods") > 0, F.col("periods")).when((F.size("entities") == 1) & among(F.col("mode"), YEARLY), F.array().cast(TEXTS)).otherwise(any_)
    axes = {
        "entity": F.col("entities"),
        "period": periods,
        "month": F.when(F.size("months") > 0, F.col("months")).otherwise(any_),
        "measure": F.when(F.size("measures") > 0, F.col("measures")).otherwise(F.array(F.lit("during"))),
        "metric": F.when(F.size(certain) > 0, certain).otherwise(F.col("metrics")),
    }
    out = s.select("spec_id", "mode", F.size("entities").alias("n_entities"), ((F.size("entities") > 1) & (F.size("periods") == 0)).alias("aligned"), *(a.alias(f"{k}_all") for k, a in axes.items()))
    slot = F.lit(0)
    for k in axes:
        rest = [c for c in out.columns if c != f"{k}_all"]
        out = out.select(*rest, F.size(f"{k}_all").alias(f"{k}_n"), F.posexplode(f"{k}_all").alias(f"{k}_at", k))
        slot = slot * F.col(f"{k}_n") + F.col(f"{k}_at")
    return out.select("spec_id", "mode", "n_entities", "aligned", slot.alias("slot"), F.col("entity_at").alias("entity_at"), *axes)


DIMENSION = ("f_entity", "f_metric", "f_month", "f_period", "f_measure", "f_unit")


def _valued(facts: DataFrame) -> DataFrame:
    """Facts with a value: what is told of them (``best``), table_title, page, and the keys of their dimension (DIMENSION)."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keys = {"f_entity": low("entity_name"), "f_metric": low("metric"), "f_month": low("reporting_month"), "f_period": F.replace(low("period"), F.lit(" ")), "f_measure": low("measure"), "f_unit": low("unit")}
    return facts.where("value is not null and not isnan(value)").select(F.struct("fact_id", "entity_name", "period", "unit", "value").alias("best"), "table_title", "page", *(keys[k].alias(k) for k in DIMENSION))


def _by_dimension(valued: DataFrame) -> DataFrame:
    untitled = F.when(F.coalesce(F.col("table_title"), F.lit("")).rlike(r"(?i)table\s+\d"), 0).otherwise(1)
    order = F.struct(untitled.alias("untitled"), F.coalesce("page", F.lit(0)).alias("page"), F.col("best.fact_id"))
    out = by_hash(valued, DIMENSION).agg(F.count("*").alias("n"), F.min("best.value").alias("low"), F.max("best.value").alias("high"), F.min(order).alias("rank"), F.min_by("best", order).alias("best")).drop(HASH)
    return out.withColumn("conflict", F.col("high") - F.col("low") > TOLERANCE)


def resolved(facts: DataFrame) -> DataFrame:
    """One row for each dimension (entity, metric, month, period, measure and unit, without regard to case) of facts (ANA-12): the number of its facts, the range of their
    values, ``conflict`` where they differ by over 1e-6, and the preferred fact: with a numbered table in its title, of the smallest page (none counts as 0), of the smallest id.
    Facts: fact_id, entity_name, metric, reporting_month, period, measure, value, unit, table_title, page; without a value a fact takes no part."""
    return _by_dimension(_valued(facts))


def disagreements(facts: DataFrame, most: int = 6) -> DataFrame:
    """Dimensions of facts whose values differ (VAL-9), with the number of their distinct values (to six places) and the ``most`` smallest as evidence, each with its first fact.
    Facts are read and shuffled once, by dimension; what agrees goes before values are told apart."""
    keys = ["entity_name", "metric", "reporting_month", "period", "measure", "unit"]
    rows = facts.where("value is not null and not isnan(value)").select(*keys, F.round("value", 6).alias("value"), "fact_id", F.xxhash64(*keys).alias(HASH))
    dimension = Window.partitionBy(HASH, *keys)
    odd = rows.withColumn("spread", F.max("value").over(dimension) - F.min("value").over(dimension)).where(F.col("spread") > TOLERANCE)
    values = odd.groupBy(HASH, *keys, "value").agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("fact_id"))
    ranked = values.withColumn("place", F.row_number().over(dimension.orderBy("value")))
    first = F.when(F.col("place") <= most, F.struct("place", "value", "fact_id", "n_facts"))  # null beyond, which lists leave out
    return ranked.groupBy(HASH, *keys).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(first)).alias("evidence")).drop(HASH)


def answers_metric(want: Column, have: Column) -> Column:
    """Whether a fact's metric fills a slot's (both in lower case): coal takes coal production, production any commodity, others what holds the other's name."""
    wide = F.contains(have, F.lit("production")) | among(have, PRODUCTION)
    return F.when(want == "coal", among(have, COAL)).when(want == "lignite", have == "lignite").when(want == "production", wide).otherwise(F.contains(have, want) | ((have != "") & F.contains(want, have)))


def names_that_answer(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (entity, f_entity) of an asked name and a stored one that equals it or holds all its significant words (FN-9). Asked names meet stored ones through their rarest
    word alone, so that a word that many names hold brings together only those that have nothing rarer."""
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(significant_words(F.col(c)))).alias("word"))
    stored = words(names, "f_entity")
    rare = words(asked, "entity").join(stored.groupBy("word").agg(F.count("*").alias("n")), "word")
    first = rare.groupBy("entity").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = first.join(stored, "word").where(F.size(F.array_except(significant_words(F.col("entity")), significant_words(F.col("f_entity")))) == 0).select("entity", "f_entity")
    equal = asked.select("entity", F.lower(F.trim("entity")).alias("f_entity")).join(names, "f_entity", "left_semi")
    return met.unionByName(equal.select("entity", "f_entity")).distinct()


def candidates(specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Every required slot with the resolved dimensions that fill it; a slot that nothing fills stays, with nulls. A slot takes whole dimensions, so that facts which fill none go before they are grouped."""
    need, valued = required_slots(specs), _valued(facts)
    names = names_that_answer(need.select("entity").distinct(), valued.select("f_entity").distinct())
    month = F.col("month").isNull() | (F.lower("month") == F.col("f_month"))
    spelled = F.array_append(F.transform(N.period_forms(F.col("period")), lambda p: F.replace(p, F.lit(" "))), F.lower("period"))
    period = F.col("period").isNull() | F.array_contains("spelled", F.col("f_period"))
    fits = (F.col("a_entity") == F.col("f_entity")) & (F.lower("measure") == F.col("f_measure")) & answers_metric(F.lower("metric"), F.col("f_metric")) & month & period
    reach = once(need, spelled=spelled).join(names.withColumnRenamed("f_entity", "a_entity"), "entity", "left")  # spelled once for each slot, not for each pair
    return reach.join(_by_dimension(valued.join(reach, fits, "left_semi")), fits, "left").drop("spelled")


def _kept_candidates(specs: DataFrame, facts: DataFrame) -> DataFrame:
    """The candidates as a checkpoint: several aggregates read them, and facts are to be scanned and grouped once."""
    ensure_checkpoints(facts.sparkSession)
    return candidates(specs, facts).checkpoint()


def _first_filling() -> list[Column]:
    order = F.when(F.col("best").isNotNull(), F.struct("rank.untitled", "rank.page", "rank.fact_id"))
    return [F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("conflict"), F.min_by("best", order).alias("best"), F.min_by("f_unit", order).alias("f_unit"), F.min_by("f_entity", order).alias("f_entity"), F.min_by("f_period", order).alias("f_period"), F.min(F.when(F.col("conflict"), F.col("low"))).alias("low"), F.max(F.when(F.col("conflict"), F.col("high"))).alias("high")]


def _by_slot(rows: DataFrame) -> DataFrame:
    return rows.groupBy("spec_id", "mode", "aligned", "slot", "entity", "metric", "month", "period", "measure").agg(*_first_filling())


def filled_slots(specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Each required slot with its state (JN-13): ``value`` with the fact that fills it (of several dimensions the preferred fact's), ``conflict`` with the range of values that
    disagree about one dimension, or ``missing``. Facts as in resolved(); repeated facts count once."""
    state = F.when(F.col("conflict"), "conflict").when(F.col("best").isNull(), "missing").otherwise("value")
    one = lambda c: F.when(F.col("state") == "value", F.col(f"best.{c}")).alias(c)
    return _by_slot(candidates(specs, facts)).withColumn("state", state).select("spec_id", "slot", "entity", "metric", "month", "period", "measure", "state", one("fact_id"), one("value"), one("unit"), "low", "high")


def _measured(at: Column) -> list[Column]:
    """What a comparison needs of its values: the oldest and newest, the highest and lowest (of equals as a stable sort leaves them), and whether entities, years and units differ."""
    has = F.col("best").isNotNull()
    item = F.struct(F.col("best.value").alias("value"), F.col("best.unit").alias("unit"), F.col("best.entity_name").alias("entity"), F.col("best.period").alias("period"))
    key = lambda *c: F.when(has, F.struct(*c))
    year, value = F.coalesce(N.year_start(F.col("f_period")), F.lit(0)), F.col("best.value")
    several = lambda c: F.coalesce(F.min(F.when(has, F.col(c))) != F.max(F.when(has, F.col(c))), F.lit(False))
    return [
        F.count_if(has).alias("n"),
        F.min_by(item, key(year.alias("y"), at.alias("a"))).alias("oldest"), F.max_by(item, key(year.alias("y"), at.alias("a"))).alias("newest"),
        F.max_by(item, key(value.alias("v"), (-at).alias("a"))).alias("top"), F.min_by(item, key(value.alias("v"), (-at).alias("a"))).alias("bottom"),
        several("f_entity").alias("entities"), several("f_period").alias("years"), several("f_unit").alias("units"),
    ]


def reasoned(specs: DataFrame, facts: DataFrame) -> DataFrame:
    """The verdict on each spec (ANA-11), over the facts that fill its slots (JN-13).

    conflict: two values of one dimension; ok without more where the spec compares nothing (no mode); insufficient: no slots, a slot that nothing fills (``missing`` names the first four), or no
    year that all entities share; unit_mismatch; else ok. One entity with several years: the change from the oldest to the newest, the years of the higher and the lower value (none if equal). Several entities: the
    highest and the lowest, and the change from low to high if there are two values. Several entities without a year are compared in the latest year that all of them have (``year``), with one
    value each. A change from zero has no percentage. Specs that share an id are an error of the caller's."""
    rows = _kept_candidates(specs, facts)
    slots = _by_slot(rows)
    label = F.concat_ws(" ", "entity", "metric", "month", "period", "measure")
    lost = F.col("best").isNull()
    plain = slots.groupBy("spec_id", "aligned").agg(F.bool_or("conflict").alias("conflict"), F.count_if(lost).alias("n_missing"), *_measured(F.col("slot")))
    missing = first_of(slots.where(lost & ~F.col("aligned")).withColumn("label", label), ["spec_id"], ["slot"], 4, ["label"], "missing")
    each = rows.where("aligned and best is not null").groupBy("spec_id", "n_entities", F.col("f_period").alias("year"), "entity_at").agg(*_first_filling())
    shared = each.groupBy("spec_id", "n_entities", "year").agg(*_measured(F.col("entity_at"))).where("n = n_entities")
    latest = one_per(shared, ["spec_id"], [F.desc(F.coalesce(N.year_start(F.col("year")), F.lit(0))), F.desc("year")])
    parts = ("n", "oldest", "newest", "top", "bottom", "entities", "years", "units")
    found_ = plain.join(latest.select("spec_id", F.col("year"), *(F.col(c).alias(f"l_{c}") for c in parts)), "spec_id", "left")
    found_ = found_.select("spec_id", "aligned", "conflict", "n_missing", "year", *(F.when(F.col("aligned"), F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) for c in parts))
    out = specs.select("spec_id", F.lower("mode").alias("mode")).join(found_, "spec_id", "left").join(missing, "spec_id", "left")
    short = F.col("aligned").isNull() | (F.col("aligned") & F.col("year").isNull()) | (~F.col("aligned") & (F.col("n_missing") > 0))
    status = F.when(F.coalesce("conflict", F.lit(False)), "conflict").when(F.col("mode").isNull(), "ok").when(short, "insufficient").when(F.col("units"), "unit_mismatch").otherwise("ok")
    out = out.withColumn("status", status).withColumn("said", (F.col("status") == "ok") & F.col("mode").isNotNull() & (F.col("n") >= 2))
    over_years = F.col("said") & ~F.col("entities") & F.col("years")
    over_names = F.col("said") & F.col("entities")
    pair = over_names & (F.col("n") == 2)
    old, new = F.when(over_years, F.col("oldest")).when(pair, F.col("bottom")), F.when(over_years, F.col("newest")).when(pair, F.col("top"))
    out = out.withColumns({"old": old, "new": new, "over_years": over_years, "over_names": over_names})
    change = N.percentage_change(F.col("new.value"), F.col("old.value"))
    up, down = F.col("new.value") > F.col("old.value"), F.col("new.value") < F.col("old.value")
    higher = F.when(F.col("over_names"), F.col("top.entity")).when(F.col("over_years") & up, F.col("new.period")).when(F.col("over_years") & down, F.col("old.period"))
    lower = F.when(F.col("over_names"), F.col("bottom.entity")).when(F.col("over_years") & up, F.col("old.period")).when(F.col("over_years") & down, F.col("new.period"))
    alone = F.col("over_names")
    side = lambda c: F.when(alone, F.col(f"{c}.entity")).otherwise(F.col(f"{c}.period"))
    return out.select(
        "spec_id", "status", F.coalesce("n", F.lit(0)).alias("n_values"), F.when(F.col("status") == "insufficient", F.transform("missing", lambda m: m["label"])).alias("missing"), "year",
        higher.alias("higher"), lower.alias("lower"), side("old").alias("from_label"), side("new").alias("to_label"), F.col("old.value").alias("from_value"), F.col("new.value").alias("to_value"),
        F.col("new.unit").alias("unit"), (F.col("new.value") - F.col("old.value")).alias("change"), F.round(change["value"], 2).alias("percent"), change["undefined"].alias("percent_undefined"))



#: What a pack warns of, in this order.
WARNINGS = {
    "conflict": "Conflicting evidence: no single value was selected.",
    "missing": "A required value was not found.",
    "unverified": "Only unverified facts were found.",
    "nothing": "No reliable evidence was found.",
}


def packs(specs: DataFrame, facts: DataFrame, texts: DataFrame, conflicts: DataFrame, most: int = 10) -> DataFrame:
    """One evidence pack for each spec (RET-12): the first ``most`` of its structured facts (the preferred fact of each dimension that fills a slot, by slot), texts (by score), stored conflicts
    and missing slots, with the number of all of them, what to warn of, and how the spec can be answered (RET-13).

    Facts as in resolved(), with status; texts: spec_id, id, document_id, page, score; conflicts: fingerprint, entity_name, metric, period, which reach the specs that one of their facts
    fills. Rows are ranked before lists are made, so that no list outgrows ``most``; a pack without evidence has empty lists."""
    rows = _kept_candidates(specs, facts)
    hit = rows.where("best is not null").groupBy("spec_id", "f_entity", "f_metric", "f_month", "f_period", "f_measure", "f_unit").agg(F.min("slot").alias("slot"), F.first("best").alias("best"), F.first("conflict").alias("conflict"))
    structured = hit.select("spec_id", "slot", "best.*", "conflict").join(facts.select("fact_id", among(F.col("status"), N.VERIFIED).alias("verified")).groupBy("fact_id").agg(F.max("verified").alias("verified")), "fact_id")
    missing = _by_slot(rows).where("best is null").select("spec_id", "slot", "entity", "metric", "month", "period", "measure")
    low = lambda c: F.lower(F.trim(c))
    stored = conflicts.select("fingerprint", low("entity_name").alias("f_entity"), low("metric").alias("f_metric"), F.replace(low("period"), F.lit(" ")).alias("f_period"))
    open_ = hit.select("spec_id", "f_entity", "f_metric", "f_period").distinct().join(stored, ["f_entity", "f_metric", "f_period"]).select("spec_id", "fingerprint").distinct()
    parts = {
        "structured": (structured, ["slot", "fact_id"], ["fact_id", "entity_name", "period", "value", "unit", "conflict", "verified"]),
        "texts": (texts, [F.desc("score"), "id"], ["id", "document_id", "page", "score"]),
        "conflicts": (open_, ["fingerprint"], ["fingerprint"]),
        "missing": (missing, ["slot"], ["entity", "metric", "month", "period", "measure"]),
    }
    out = specs.select("spec_id")
    for name, (df, order, what) in parts.items():
        flags = [F.max("conflict").alias("disputed"), F.max("verified").alias("verified")] if name == "structured" else []
        out = out.join(df.groupBy("spec_id").agg(F.count("*").alias(f"n_{name}"), *flags), "spec_id", "left").join(first_of(df, ["spec_id"], order, most, what, name), "spec_id", "left")
    counted = {f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)) for name in parts}
    out = out.withColumns(counted | {name: F.coalesce(name, F.array()) for name in parts})
    signs = {
        "conflict": F.coalesce("disputed", F.lit(False)) | (F.col("n_conflicts") > 0),
        "missing": F.col("n_missing") > 0,
        "unverified": (F.col("n_structured") > 0) & ~F.coalesce("verified", F.lit(False)),
        "nothing": F.col("n_structured") + F.col("n_texts") == 0,
    }
    warnings = F.array_compact(F.array(*(F.when(sign, WARNINGS[k]) for k, sign in signs.items())))
    return out.select("spec_id", route(F.col("n_structured"), F.col("n_texts")).alias("route"), *counted, *parts, warnings.alias("warnings"))
