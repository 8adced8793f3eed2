"""Registered queries over the star tables, each with SQL that another engine can run on the same tables.

Queries run over whole tables through the views of lodestone.sources.views. The SQL is written on its own, from the semantics, and uses
the views' definitions as subqueries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.operators import analytics as A
from lodestone.operators import corpus as C
from lodestone.operators import evidence as D
from lodestone.operators import extract as T
from lodestone.operators import facts as X
from lodestone.operators import geology as E
from lodestone.operators import layout as Y
from lodestone.operators import retrieve as R
from lodestone.operators import review as W
from lodestone.operators import validate as V
from lodestone.sources.cut import ensure_checkpoints
from lodestone.sources.store import sheets_to_pages, upserted
from lodestone.sources.views import VIEWS, expanded, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The views and tables of one data folder; ``whole`` for views that don't fold parts and suppliers, where there are such."""

    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = False):
        self.spark, self.sf_dir, self.whole = spark, sf_dir, whole

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"v_{name}_whole" if self.whole and f"v_{name}_whole" in VIEWS else f"v_{name}") if name in ("fact", "document", "upload", "index", "geo", "conflict", "review", "page", "report_page", "core_page", "ask", "layout_page") else table(self.spark, self.sf_dir, name)

    @property
    def index_facts(self) -> DataFrame:
        """Index facts read back from chunks whose metadata is JSON, as a chunk table stores it."""
        meta = F.to_json(F.struct("entity", "metric", "reporting_month", "fiscal_year", "measurement_type", "value", "unit", "page"))
        return X.index_facts(self.index.select("chunk_id", "document_id", meta.alias("meta"), F.lit(True).alias("is_active"), F.lit("structured_fact").alias("content_type")))

    @property
    def classified(self) -> DataFrame:
        return X.classified(self.index_facts, self.fact)

    @property
    def usable(self) -> DataFrame:
        return A.usable(self.fact, self.document, self.conflict)

    @property
    def typed(self) -> DataFrame:
        return E.typed(self.geo)


def query(sql: str | None = None, whole: bool = False):
    """Registers a query and its SQL; with ``whole`` once more as NAME_whole, over the views that don't fold parts and suppliers."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        text = PRELUDE + sql if re.search(r"\b(fx|ver|ux|px|ix|cx|gx)\b", sql or "") else sql
        if text is not None:
            SQL[f.__name__] = expanded(text)
        if whole:
            QUERIES[f"{f.__name__}_whole"] = lambda spark, sf_dir: f(Tables(spark, sf_dir, True))
            if text is not None:
                SQL[f"{f.__name__}_whole"] = expanded(re.sub(r"\{(v_\w+)\}", lambda m: f"{{{m[1]}_whole}}" if f"{m[1]}_whole" in VIEWS else m[0], text))
        return f

    return add


#: fx: normalised facts; ux: usable ones; ix: index facts; cx: classified rows; gx: typed geological rows.
PRELUDE = r"""
WITH vf AS MATERIALIZED (SELECT * FROM {v_fact} v),
fx AS (SELECT vf.*, lower(entity_name) AS entity, field_name AS field, financial_year AS period,
         CASE WHEN unit = 'MT' THEN numeric_value * 1000000 ELSE numeric_value END AS base_value, unit IS NULL AS review FROM vf),
ver AS (SELECT * FROM fx WHERE status IN ('high_confidence', 'approved', 'corrected')),
latest AS (SELECT document_id FROM {v_document} d QUALIFY row_number() OVER (PARTITION BY lower(filename) ORDER BY version DESC, document_id DESC) = 1),
openc AS (SELECT DISTINCT lower(entity_name) AS entity, field_name AS field, period FROM {v_conflict} c WHERE status = 'review_required'),
ux AS (SELECT v.* FROM ver v SEMI JOIN latest l ON v.document_id = l.document_id ANTI JOIN openc o ON v.entity = o.entity AND v.field = o.field AND v.period = o.period),
px AS (SELECT * FROM ux QUALIFY row_number() OVER (PARTITION BY entity, field, period ORDER BY confidence_score DESC, id DESC) = 1),
ix AS MATERIALIZED (SELECT chunk_id, document_id, entity AS entity_name, CASE metric WHEN 'Output' THEN 'production' ELSE lower(metric) END AS metric, reporting_month, 'FY' || fiscal_year AS period, measurement_type AS measure, value, unit,
         CAST(0.9 AS DOUBLE) AS confidence, page FROM {v_index} v),
cx AS (SELECT CASE WHEN metric IN ('coal', 'lignite') THEN metric END AS commodity, 'production' AS metric, measure, metric AS storage_metric, document_id, entity_name, period, reporting_month, value, unit, confidence, chunk_id AS fact_id, 'index' AS source FROM ix
  UNION ALL SELECT NULL, CASE field WHEN 'production_target' THEN 'production' ELSE field END, CASE field WHEN 'production_target' THEN 'target' END, field, document_id, entity_name, period, NULL, numeric_value, unit, confidence_score, id, 'extracted' FROM ver),
gx AS MATERIALIZED (SELECT v.*, CASE metric_kind WHEN 'workable_thickness' THEN 'minimum_workable_seam_thickness' WHEN 'resources' THEN 'resource_quantity' ELSE metric_kind END AS kind,
         CASE WHEN status = 'approved' THEN 'verified' WHEN status = 'rejected' THEN 'rejected' ELSE 'review_required' END AS bucket,
         CASE WHEN seam_status = 'uncorrelated' THEN 'Uncorrelated coal seam' ELSE 'Seam ' || seam_name END AS seam,
         CASE WHEN geological_formation LIKE '%Raniganj%' THEN 'Raniganj Formation' WHEN geological_formation LIKE '%Barakar%' THEN 'Barakar Formation' END AS formation,
         replace(lower(borehole_id), '-', '') AS borehole_key, value_num * CAST(CASE length_unit WHEN 'm' THEN 1.0 WHEN 'cm' THEN 0.01 ELSE 0.3048 END AS DOUBLE) AS metres FROM {v_geo} v)
"""


# Facts ---------------------------------------------------------------------------------------------------------


@query("SELECT id, entity, field, period, CASE WHEN unit IS NULL THEN 'unknown' ELSE 'tonnes' END AS canonical, review, CAST(base_value AS DOUBLE) AS base_value FROM fx", whole=True)
def normalized_facts(t: Tables) -> DataFrame:
    return X.normalized(t.fact).select("id", "entity", "field", "period", F.col("unit_norm.canonical").alias("canonical"), F.col("unit_norm.review").alias("review"), "base_value")


@query("SELECT v.id, v.document_id, d.filename AS document_name, d.version AS document_version, v.page_number FROM ver v SEMI JOIN latest l ON v.document_id = l.document_id LEFT JOIN {v_document} d ON v.document_id = d.document_id", whole=True)
def latest_verified_facts(t: Tables) -> DataFrame:
    return X.with_document(X.of_latest(X.verified(t.fact), t.document), t.document).select("id", "document_id", "document_name", "document_version", "page_number")


@query("SELECT chunk_id, entity_name, metric, reporting_month, period, measure, value, confidence, page FROM ix", whole=True)
def index_facts_from_chunks(t: Tables) -> DataFrame:
    return t.index_facts.select("chunk_id", "entity_name", "metric", "reporting_month", "period", "measure", "value", "confidence", "page")


@query("SELECT chunk_id, entity_name, period, value FROM ix WHERE metric = 'coal' AND entity_name = 'Mine 7' AND lower(reporting_month) = 'march' AND measure = 'during'")
def index_fact_filter(t: Tables) -> DataFrame:
    return X.filter_index_facts(t.index_facts, "mine-7", "coal", None, "March", "actual").select("chunk_id", "entity_name", "period", "value")


@query("SELECT fact_id, entity_name, commodity, metric, measure, storage_metric, period, value, source FROM cx", whole=True)
def classified_facts(t: Tables) -> DataFrame:
    return t.classified.select("fact_id", "entity_name", "commodity", "metric", "measure", "storage_metric", "period", "value", "source")


@query("SELECT fact_id, entity_name, storage_metric, period, measure, value, source FROM cx QUALIFY row_number() OVER (PARTITION BY lower(entity_name), storage_metric, period, round(value, 6), coalesce(measure, '') ORDER BY CASE source WHEN 'index' THEN 0 ELSE 1 END, fact_id) = 1", whole=True)
def merged_facts(t: Tables) -> DataFrame:
    return X.merged(t.classified).select("fact_id", "entity_name", "storage_metric", "period", "measure", "value", "source")


# Analytics -----------------------------------------------------------------------------------------------------


@query("SELECT entity, field, period, numeric_value, unit, id, document_id, page_number, status, CASE WHEN count(*) OVER (PARTITION BY entity, field) >= 2 THEN 'line' ELSE 'bar' END AS chart_type FROM px", whole=True)
def trend(t: Tables) -> DataFrame:
    return A.trend(t.usable).select("entity", "field", "period", "numeric_value", "unit", "id", "document_id", "page_number", "status", "chart_type")


@query("SELECT a.entity, a.period, a.numeric_value AS actual, b.numeric_value AS target, a.id AS actual_id, b.id AS target_id, round(a.numeric_value / nullif(b.numeric_value, 0) * 100, 2) AS achievement FROM px a JOIN px b ON a.entity = b.entity AND a.period = b.period WHERE a.field = 'production' AND b.field = 'production_target'", whole=True)
def actual_vs_target(t: Tables) -> DataFrame:
    return A.actual_vs_target(t.usable).select("entity", "period", "actual", "target", "actual_id", "target_id", "achievement")


@query("""SELECT entity, period, numeric_value, unit, id, (SELECT count(DISTINCT lower(coalesce(unit, ''))) > 1 FROM (SELECT * FROM (SELECT *, max(period) OVER (PARTITION BY entity) AS m FROM ux WHERE field = 'production') WHERE period = m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY confidence_score DESC, id DESC) = 1)) AS withheld
FROM (SELECT *, max(period) OVER (PARTITION BY entity) AS m FROM ux WHERE field = 'production') WHERE period = m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY confidence_score DESC, id DESC) = 1""", whole=True)
def compare_entities(t: Tables) -> DataFrame:
    return A.compare_entities(t.usable).select("entity", "period", "numeric_value", "unit", "id", "withheld")


@query("""SELECT coalesce(p.entity, q.entity) AS entity, coalesce(p.period, q.period) AS period, p.numeric_value AS trend_value, q.actual, q.target, q.achievement
FROM (SELECT * FROM px WHERE field = 'production') p FULL JOIN (SELECT a.entity, a.period, a.numeric_value AS actual, b.numeric_value AS target, round(a.numeric_value / nullif(b.numeric_value, 0) * 100, 2) AS achievement FROM px a JOIN px b ON a.entity = b.entity AND a.period = b.period WHERE a.field = 'production' AND b.field = 'production_target') q ON p.entity = q.entity AND p.period = q.period""", whole=True)
def period_table(t: Tables) -> DataFrame:
    return A.period_table(t.usable)


@query("SELECT count(*) AS verified_facts, count(DISTINCT entity) AS entities, count(DISTINCT field) AS metrics, round(avg(confidence_score), 3) AS mean_confidence FROM ver", whole=True)
def overview(t: Tables) -> DataFrame:
    return A.overview(t.fact)


@query("SELECT entity, CAST(sum(base_value) AS DOUBLE) AS total, count(*) AS fact_count FROM ver WHERE field = 'production' GROUP BY entity ORDER BY total DESC, entity LIMIT 8", whole=True)
def top_entities(t: Tables) -> DataFrame:
    return A.top_entities(t.fact)


@query("SELECT storage_metric, unit, sum(value) AS total, count(*) AS n FROM cx WHERE storage_metric IN ('production', 'coal', 'overburden', 'dispatch', 'lignite') GROUP BY storage_metric, unit", whole=True)
def production_by_commodity(t: Tables) -> DataFrame:
    return A.by_commodity(t.classified)


@query("""SELECT bucket, count(id) AS n FROM (VALUES ('0.9-1.0'), ('0.8-0.9'), ('0.7-0.8'), ('below 0.7')) b(bucket)
LEFT JOIN (SELECT id, CASE WHEN confidence_score >= 0.9 THEN '0.9-1.0' WHEN confidence_score >= 0.8 THEN '0.8-0.9' WHEN confidence_score >= 0.7 THEN '0.7-0.8' ELSE 'below 0.7' END AS bucket FROM ver) v USING (bucket) GROUP BY bucket""", whole=True)
def confidence_histogram(t: Tables) -> DataFrame:
    return A.confidence_histogram(t.fact)


@query("SELECT strftime(created_at, '%Y-%m') AS month, status, count(*) AS n FROM {v_upload} u GROUP BY 1, 2")
def monthly_uploads(t: Tables) -> DataFrame:
    return A.monthly_uploads(t.upload)


@query("SELECT DISTINCT axis, value FROM (SELECT unnest(['entity_name', 'commodity', 'metric', 'measure', 'period', 'reporting_month']) AS axis, unnest([entity_name, commodity, metric, measure, period, reporting_month]) AS value FROM cx) WHERE value IS NOT NULL", whole=True)
def dimensions(t: Tables) -> DataFrame:
    return A.dimensions(t.classified)


@query("SELECT entity_name, CAST(sum(CASE WHEN storage_metric IN ('production', 'coal', 'overburden', 'dispatch', 'lignite') THEN 3 ELSE 1 END) AS BIGINT) AS score FROM cx GROUP BY entity_name", whole=True)
def entity_scores(t: Tables) -> DataFrame:
    return A.entity_scores(t.classified)


@query("""SELECT document_id, filename, coalesce(p, 0) AS production_facts, coalesce(g, 0) AS geological_facts, CASE WHEN coalesce(g, 0) > 0 AND coalesce(p, 0) = 0 THEN 'geological' WHEN coalesce(g, 0) > 0 THEN 'mixed' ELSE 'production' END AS domain, coalesce(p, 0) + coalesce(g, 0) > 0 AS has_data
FROM {v_document} d LEFT JOIN (SELECT document_id, count(*) AS p FROM ver GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS g FROM gx GROUP BY 1) USING (document_id)""")
def document_counts(t: Tables) -> DataFrame:
    return A.document_counts(t.document, X.verified(t.fact), t.geo)


@query("SELECT count(*) AS total, count(*) FILTER (status = 'UPLOADED') AS pending, count(*) FILTER (status = 'PROCESSING') AS processing, count(*) FILTER (status = 'COMPLETED') AS completed FROM {v_upload} u")
def dashboard(t: Tables) -> DataFrame:
    return A.dashboard(t.upload)


@query("SELECT document_id, filename, created_at FROM {v_upload} u ORDER BY created_at DESC, document_id DESC LIMIT 5")
def newest_uploads(t: Tables) -> DataFrame:
    return A.newest(t.upload).select("document_id", "filename", "created_at")


@query("SELECT 'documents' AS name, count(*) AS n FROM {v_upload} u UNION ALL SELECT 'facts', count(*) FROM fx UNION ALL SELECT 'structured_chunks', count(*) FROM ix UNION ALL SELECT 'geological_facts', count(*) FROM gx")
def status_counts(t: Tables) -> DataFrame:
    return A.status_counts(documents=t.upload, facts=t.fact, structured_chunks=t.index, geological_facts=t.geo)


ASKED = ["mine 7", "mine 12", "mine 30"]  # a question about three entities
_ASKED = ", ".join(f"'{e}'" for e in ASKED)


@query(f"SELECT field, max(period) AS period FROM (SELECT field, period, count(DISTINCT entity) AS n, any_value(m) AS m FROM (SELECT f.field, f.period, f.entity, (SELECT count(DISTINCT entity) FROM fx g WHERE g.status <> 'rejected' AND g.field = f.field AND g.entity IN ({_ASKED})) AS m FROM fx f WHERE f.status <> 'rejected' AND f.entity IN ({_ASKED})) GROUP BY 1, 2) WHERE n = m GROUP BY field")
def latest_common_year(t: Tables) -> DataFrame:
    return A.common_year(X.normalized(t.fact.where("status <> 'rejected'")).where(F.col("entity").isin(ASKED)))


@query("""SELECT id, entity, field, period, base_value, before, base_value - before AS change, round((base_value - before) / nullif(before, 0) * 100, 2) AS percent FROM (SELECT *, lag(base_value) OVER (PARTITION BY entity, field ORDER BY period) AS before FROM px)""", whole=True)
def year_changes(t: Tables) -> DataFrame:
    return A.year_changes(t.usable).select("id", "entity", "field", "period", "base_value", "before", "change", "percent")


@query("""SELECT entity_name, storage_metric, period, measure, reporting_month, unit, count(*) AS n, min(value) AS low, max(value) AS high, arg_min(fact_id, row(document_id, fact_id)) AS fact_id, max(value) - min(value) > 1e-6 AS conflict FROM cx GROUP BY ALL""", whole=True)
def unique_facts(t: Tables) -> DataFrame:
    return A.unique_facts(t.classified)


# Validation ----------------------------------------------------------------------------------------------------

REPS = """, rp AS (SELECT f.*, lower(d.filename) AS file FROM fx f JOIN {v_document} d ON f.document_id = d.document_id WHERE f.status <> 'rejected'
 QUALIFY row_number() OVER (PARTITION BY entity, field, period, lower(d.filename) ORDER BY d.version DESC, id DESC) = 1),
pairs AS (SELECT a.entity, a.field, a.period, a.id AS a_id, b.id AS b_id, a.document_id AS ad, b.document_id AS bd, a.base_value AS a_base, b.base_value AS b_base, a.review OR b.review AS review,
  abs(a.base_value - b.base_value) <= 0.01 OR abs(a.base_value - b.base_value) / greatest(abs(a.base_value), abs(b.base_value), 1e-12) <= 0.002 AS same
 FROM rp a JOIN rp b ON a.entity = b.entity AND a.field = b.field AND a.period = b.period AND a.document_id < b.document_id),
found AS MATERIALIZED (SELECT CASE WHEN review THEN left(sha256('unit|' || entity || '|' || field || '|' || period || '|' || least(a_id, b_id) || '|' || greatest(a_id, b_id)), 40) ELSE left(sha256('contra|' || entity || '|' || field || '|' || period || '|' || ad || '|' || bd), 40) END AS fingerprint,
  CASE WHEN review THEN 'unit_review' ELSE 'contradiction' END AS conflict_type, CASE WHEN review THEN 'low' ELSE 'high' END AS severity, entity, field, period, a_id, b_id, a_base, b_base FROM pairs WHERE review OR NOT same)
"""


@query(REPS + "SELECT * FROM found", whole=True)
def cross_document_conflicts(t: Tables) -> DataFrame:
    return V.cross_document(t.fact, t.document)


def _found(t: Tables) -> DataFrame:
    """The conflicts between documents, found once: a checkpoint, because the queries below read them several times."""
    ensure_checkpoints(t.spark)
    return V.cross_document(t.fact, t.document).checkpoint()


def _stored(found: DataFrame) -> DataFrame:
    """A former snapshot: the conflicts of even first digits, by first digit open or settled, and one that is found no more."""
    digit = F.conv(F.substring("fingerprint", 1, 1), 16, 10).cast("int")
    old = found.where(digit % 2 == 0).select("fingerprint", F.when(digit % 4 == 0, "review_required").when(digit % 8 == 2, "confirmed").otherwise("dismissed").alias("status"))
    gone = found.where(digit % 2 == 1).select(F.reverse("fingerprint").alias("fingerprint"), F.lit("review_required").alias("status"))
    return old.unionByName(gone.join(found, "fingerprint", "left_anti")).distinct()


STORED = """, digits AS (SELECT fingerprint, strpos('0123456789abcdef', left(fingerprint, 1)) - 1 AS d FROM found),
stored AS (SELECT fingerprint, CASE WHEN d % 4 = 0 THEN 'review_required' WHEN d % 8 = 2 THEN 'confirmed' ELSE 'dismissed' END AS status FROM digits WHERE d % 2 = 0
 UNION SELECT reverse(fingerprint), 'review_required' FROM digits WHERE d % 2 = 1 AND reverse(fingerprint) NOT IN (SELECT fingerprint FROM found)),
merged AS (SELECT coalesce(s.fingerprint, f.fingerprint) AS fingerprint, s.status AS old, f.fingerprint IS NOT NULL AS seen, s.fingerprint IS NOT NULL AS known FROM stored s FULL JOIN (SELECT DISTINCT fingerprint FROM found) f ON s.fingerprint = f.fingerprint),
state AS MATERIALIZED (SELECT fingerprint, CASE WHEN NOT known OR (seen AND old = 'review_required') THEN 'review_required' WHEN old = 'review_required' THEN 'dismissed' ELSE old END AS status,
 CASE WHEN NOT known THEN 'created' WHEN seen AND old = 'review_required' THEN 'refreshed' WHEN old = 'review_required' THEN 'auto_cleared' WHEN seen THEN 'unchanged_terminal' ELSE 'kept' END AS outcome FROM merged)
"""


@query(REPS + STORED + "SELECT * FROM state", whole=True)
def conflict_state_merge(t: Tables) -> DataFrame:
    found = _found(t)
    return V.merge_state(_stored(found), found)


@query(REPS + STORED + """, newest AS MATERIALIZED (SELECT seq % 16 AS d, action, corrected_value FROM {v_review} r QUALIFY row_number() OVER (PARTITION BY seq % 16 ORDER BY acted_at DESC, action_id DESC) = 1),
acts AS (SELECT fingerprint, a.action, CAST(a.corrected_value AS VARCHAR) AS value FROM state s JOIN newest a ON strpos('0123456789abcdef', substr(fingerprint, 2, 1)) - 1 = a.d)
SELECT fingerprint, CASE WHEN action = 'approve' THEN 'confirmed' WHEN action = 'reject' THEN 'dismissed' ELSE 'resolved' END AS status FROM state JOIN acts USING (fingerprint)""")
def conflict_transitions(t: Tables) -> DataFrame:
    found = _found(t)
    state = V.merge_state(_stored(found), found).select("fingerprint", "status")
    digit = F.conv(F.substring("fingerprint", 2, 1), 16, 10).cast("long")
    last = X.one_per(t.review.withColumn("digit", F.col("seq") % 16), ["digit"], [F.desc("acted_at"), F.desc("action_id")])
    verbs = {"approve": "confirm", "reject": "dismiss", "correct": "resolve"}
    acts = state.select("fingerprint", digit.alias("digit")).join(last, "digit").select("fingerprint", F.create_map(*[F.lit(x) for p in verbs.items() for x in p])[F.col("action")].alias("action"), F.coalesce(F.col("corrected_value").cast("string"), F.lit("0")).alias("value"), "acted_at", "action_id")
    return V.apply_transitions(state.join(acts.select("fingerprint"), "fingerprint", "left_semi"), acts).select("fingerprint", "status")


@query(REPS + STORED + "SELECT count(*) FILTER (status = 'review_required') AS review_required, count(*) FILTER (status = 'dismissed') AS dismissed, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'resolved') AS resolved, (SELECT count(*) FROM fx) AS facts, greatest(0, (SELECT count(*) FROM fx) - count(*) FILTER (status = 'review_required')) AS validated FROM state")
def conflict_stats(t: Tables) -> DataFrame:
    found = _found(t)
    return V.conflict_stats(V.merge_state(_stored(found), found), t.fact)


#: Every fourth entity is also known by a longer name, which documents 1 and up use.
LONG = "CASE WHEN document_id <> 'doc0' AND CAST(substr(entity_name, 6) AS INT) % 4 = 0 THEN entity_name || ' Deep Complex' ELSE entity_name END"


@query("""SELECT left(sha256('entity|' || a.field || '|' || a.period || '|' || a.entity || '|' || b.entity), 40) AS fingerprint, a.field, a.period, a.entity AS a_entity, b.entity AS b_entity
FROM (SELECT field, period, lower(%s) AS entity, min(document_id) AS lo, max(document_id) AS hi, max(length(split_part(entity_name, ' ', 2))) AS n FROM fx WHERE status <> 'rejected' GROUP BY 1, 2, 3) a
JOIN (SELECT field, period, lower(%s) AS entity, min(document_id) AS lo, max(document_id) AS hi, split_part(lower(entity_name), ' ', 2) AS code FROM fx WHERE status <> 'rejected' GROUP BY 1, 2, 3, 6) b
ON a.field = b.field AND a.period = b.period AND a.entity < b.entity
WHERE (a.lo <> b.hi OR a.hi <> b.lo) AND a.entity NOT LIKE '%%complex' AND b.entity LIKE '%%complex' AND (split_part(a.entity, ' ', 2) = b.code OR length(split_part(a.entity, ' ', 2)) = 1)
UNION ALL SELECT left(sha256('entity|' || a.field || '|' || a.period || '|' || a.entity || '|' || b.entity), 40), a.field, a.period, a.entity, b.entity
FROM (SELECT field, period, lower(%s) AS entity, min(document_id) AS lo, max(document_id) AS hi FROM fx WHERE status <> 'rejected' GROUP BY 1, 2, 3) a
JOIN (SELECT field, period, lower(%s) AS entity, min(document_id) AS lo, max(document_id) AS hi FROM fx WHERE status <> 'rejected' GROUP BY 1, 2, 3) b
ON a.field = b.field AND a.period = b.period AND a.entity < b.entity WHERE (a.lo <> b.hi OR a.hi <> b.lo) AND a.entity LIKE '%%complex' AND (length(split_part(b.entity, ' ', 2)) = 1 OR (b.entity LIKE '%%complex' AND length(split_part(a.entity, ' ', 2)) = 1))""" % (LONG, LONG, LONG, LONG))
def ambiguous_entities(t: Tables) -> DataFrame:
    return V.ambiguous_entities(t.fact.withColumn("entity_name", F.expr(LONG)))


@query("""SELECT document_id, entity, period, production, production_target AS target, reported, round(production / production_target * 100, 2) AS calculated, left(sha256('disc|' || document_id || '|' || entity || '|' || period), 40) AS fingerprint
FROM (SELECT document_id, entity, period, max(numeric_value) FILTER (field = 'production') AS production, max(numeric_value) FILTER (field = 'production_target') AS production_target, round(max(numeric_value) FILTER (field = 'dispatch') / max(numeric_value) FILTER (field = 'production_target') * 100, 2) AS reported FROM fx WHERE status <> 'rejected' GROUP BY ALL)
WHERE abs(round(production / production_target * 100, 2) - reported) > 2.0""")
def achievement_discrepancies(t: Tables) -> DataFrame:
    rows = t.fact.where("status <> 'rejected'")
    wide = rows.groupBy("document_id", "entity_name", "financial_year").agg(F.max(F.when(F.col("field_name") == "dispatch", F.col("numeric_value"))).alias("d"), F.max(F.when(F.col("field_name") == "production_target", F.col("numeric_value"))).alias("g"))
    told = wide.where("d / g is not null").select(F.concat_ws("/", "document_id", "entity_name", F.lit("achievement"), "financial_year").alias("id"), "document_id", "entity_name", F.lit("Achievement %").alias("field_name"), "financial_year", F.round(F.col("d") / F.col("g") * 100, 2).alias("numeric_value"), F.lit("%").alias("unit"), F.lit("approved").alias("status"), F.lit(False).alias("is_calculated"))
    told = told.withColumn("field_name", F.lit("achievement"))
    return V.achievement_discrepancies(rows.unionByName(told, True)).select("document_id", "entity", "period", "production", "target", "reported", "calculated", "fingerprint")


@query("""SELECT document_id, entity, period, 'achievement_percentage' AS field, round(p / t * 100, 2) AS numeric_value, true AS is_calculated FROM (SELECT document_id, entity, period, max(base_value) FILTER (field = 'production') AS p, max(base_value) FILTER (field = 'production_target') AS t FROM fx WHERE status <> 'rejected' GROUP BY ALL) WHERE t <> 0 AND p IS NOT NULL""", whole=True)
def calculated_achievements(t: Tables) -> DataFrame:
    return V.calculated_achievements(t.fact)


@query("""SELECT DISTINCT a.seam AS entity_key, a.kind AS metric, a.borehole_key AS borehole, a.document_id AS a_document_id, b.document_id AS b_document_id, a.metres AS a_low, b.metres AS b_low, CASE WHEN a.document_id = b.document_id THEN 'mismatch' ELSE 'discrepancy' END AS conflict_type
FROM gx a JOIN gx b ON a.seam = b.seam AND a.kind = b.kind AND a.borehole_key = b.borehole_key WHERE a.kind = 'seam_thickness' AND a.bucket = 'verified' AND b.bucket = 'verified' AND a.metres + 1e-6 < b.metres""")
def geological_range_conflicts(t: Tables) -> DataFrame:
    rows = t.typed.where("kind = 'seam_thickness' and bucket = 'verified'").select(F.col("seam").alias("entity_key"), F.col("kind").alias("metric"), F.col("borehole_key").alias("borehole"), "document_id", F.col("metres").alias("low"), F.col("metres").alias("high"))
    return V.range_conflicts(rows).select("entity_key", "metric", "borehole", "a_document_id", "b_document_id", "a_low", "b_low", "conflict_type")


@query("SELECT id, 'thickness_without_seam' AS issue FROM gx WHERE kind = 'seam_thickness' AND seam_name IS NULL UNION ALL SELECT id, 'workable_mislabelled' FROM gx WHERE kind = 'seam_thickness' AND lower(geological_formation) LIKE '%through%'")
def geological_quality_issues(t: Tables) -> DataFrame:
    rows = t.typed.select("id", "kind", F.col("value_num").alias("value"), "seam_name", "geological_formation", F.col("metres").isNotNull().alias("unit_known"), F.when(F.lower("geological_formation").contains("through"), "the workable seam").alias("evidence"))
    return V.quality_issues(rows)


@query("""SELECT id, field_name IN ('production', 'production_target') AS ok, list_concat(CASE WHEN field_name = 'dispatch' THEN ['field_not_allowed'] ELSE [] END, list_concat(CASE WHEN unit IS NULL THEN ['unit_missing'] ELSE [] END, CASE WHEN page_number > 1 THEN ['evidence_not_found'] ELSE [] END)) AS warnings FROM fx""")
def draft_checks(t: Tables) -> DataFrame:
    drafts = t.fact.select("id", F.col("field_name").alias("field"), "numeric_value", "unit", "financial_year", F.concat_ws(" ", "entity_name", "value").alias("evidence_text"), F.when(F.col("page_number") > 1, "nothing to see").otherwise(F.concat_ws(" ", F.lit("On"), "entity_name", "value")).alias("page_text"))
    return V.check_drafts(drafts, ["production", "production_target"]).select("id", "ok", "warnings")


# Geology -------------------------------------------------------------------------------------------------------


@query("SELECT id, kind, bucket, seam, formation, borehole_key, metres FROM gx")
def typed_geological_facts(t: Tables) -> DataFrame:
    return t.typed.select("id", "kind", "bucket", "seam", "formation", "borehole_key", "metres")


@query("SELECT id, document_id, seam_name, kind FROM gx WHERE bucket <> 'rejected' AND contains(lower(seam_name), 'r4') AND kind IN ('seam_thickness')")
def browse_geological_facts(t: Tables) -> DataFrame:
    return E.browse(t.typed, seam="R4", kind="seam thickness").select("id", "document_id", "seam_name", "kind")


@query("SELECT id, seam, formation FROM gx WHERE formation = 'Barakar Formation' OR seam IN (SELECT seam FROM gx WHERE formation = 'Barakar Formation' AND bucket <> 'rejected' AND seam IS NOT NULL)")
def formation_association(t: Tables) -> DataFrame:
    return E.of_formation(t.typed, "barakar").select("id", "seam", "formation")


@query("SELECT document_id, seam, formation, value_num AS quantity, value_num * 1000000 AS tonnes, source_page, id, false AS pending FROM gx WHERE kind IN ('resource_quantity', 'reserve_quantity') AND seam IS NOT NULL AND value_num > 0 AND bucket = 'verified' QUALIFY row_number() OVER (PARTITION BY document_id, seam ORDER BY source_page, id) = 1")
def resources_by_seam(t: Tables) -> DataFrame:
    return E.resources_by_seam(t.typed)


@query("SELECT document_id, borehole_key, metres, source_page, id, false AS pending FROM gx WHERE kind = 'borehole_depth' AND bucket = 'verified' QUALIFY row_number() OVER (PARTITION BY document_id, borehole_key ORDER BY source_page, id) = 1")
def borehole_depths(t: Tables) -> DataFrame:
    return E.borehole_depths(t.typed)


@query("SELECT document_id, seam, metres, source_page, id, false AS pending FROM gx WHERE kind = 'seam_thickness' AND seam IS NOT NULL AND bucket = 'verified' QUALIFY row_number() OVER (PARTITION BY document_id, seam ORDER BY source_page, id) = 1")
def seam_thickness(t: Tables) -> DataFrame:
    return E.seam_thickness(t.typed)


SUMMARY = """, per AS (SELECT document_id, count(*) AS facts, count(DISTINCT formation) AS formations, count(DISTINCT seam) FILTER (seam_status = 'named') AS seams, count(DISTINCT borehole_key) AS boreholes, count(*) FILTER (kind IN ('resource_quantity', 'reserve_quantity')) AS resource_facts,
 count(*) FILTER (bucket = 'review_required') AS review_required, NOT bool_or(bucket = 'verified') AS pending FROM gx WHERE bucket <> 'rejected' GROUP BY document_id)"""


@query(SUMMARY + " SELECT * FROM per UNION ALL SELECT '*', CAST(sum(facts) AS BIGINT), CAST(sum(formations) AS BIGINT), CAST(sum(seams) AS BIGINT), CAST(sum(boreholes) AS BIGINT), CAST(sum(resource_facts) AS BIGINT), CAST(sum(review_required) AS BIGINT), bool_and(pending) FROM per")
def geological_summary(t: Tables) -> DataFrame:
    return E.document_summary(t.typed)


@query("SELECT document_id, filename, CASE WHEN count(*) OVER (PARTITION BY lower(filename)) > 1 THEN filename || ' [' || left(document_id, 8) || ']' ELSE filename END AS display_name FROM {v_upload} u")
def document_names(t: Tables) -> DataFrame:
    return E.disambiguated(t.upload).select("document_id", "filename", "display_name")


@query("SELECT formation, list_sort(list(DISTINCT seam) FILTER (seam IS NOT NULL)) AS seams, list_sort(list(DISTINCT document_id)) AS documents, list_sort(list(DISTINCT source_page)) AS pages, count(*) AS evidence_count, CASE WHEN bool_or(bucket = 'verified') THEN 'verified' ELSE 'review_required' END AS bucket FROM gx WHERE bucket <> 'rejected' AND formation IS NOT NULL GROUP BY formation")
def formation_rollup(t: Tables) -> DataFrame:
    return E.formations(t.typed)


@query("""SELECT document_id, seam, arg_min(formation, row(source_page, id)) FILTER (formation IS NOT NULL) AS formation, arg_min(metres, row(source_page, id)) FILTER (kind = 'seam_thickness') AS thickness, arg_min(value_num, row(source_page, id)) FILTER (kind IN ('resource_quantity', 'reserve_quantity')) AS quantity,
 list_sort(list(DISTINCT borehole_key)) AS boreholes, list_sort(list(DISTINCT source_page)) AS pages, count(*) AS evidence_count FROM gx WHERE bucket <> 'rejected' AND seam IS NOT NULL GROUP BY document_id, seam""")
def seam_rollup(t: Tables) -> DataFrame:
    return E.seams(t.typed)


@query("""SELECT document_id, borehole_key, arg_min(metres, row(source_page, id)) FILTER (kind = 'borehole_depth') AS depth, coalesce(list_sort(list(DISTINCT seam) FILTER (seam IS NOT NULL)), []) AS seams, coalesce(list_sort(list(DISTINCT formation) FILTER (formation IS NOT NULL)), []) AS formations, count(*) AS evidence_count FROM gx WHERE bucket <> 'rejected' GROUP BY document_id, borehole_key""")
def borehole_rollup(t: Tables) -> DataFrame:
    return E.boreholes(t.typed)


@query("SELECT axis, value, count(*) FILTER (bucket = 'verified') AS verified, count(*) FILTER (bucket = 'review_required') AS provisional FROM (SELECT bucket, unnest(['document_id', 'formation', 'seam', 'borehole_key', 'kind']) AS axis, unnest([document_id, formation, seam, borehole_key, kind]) AS value FROM gx WHERE bucket <> 'rejected') WHERE value IS NOT NULL GROUP BY axis, value")
def geological_dimensions(t: Tables) -> DataFrame:
    return E.filter_dimensions(t.typed)


@query("SELECT formation, list_sort(list(seam || ':' || n)) AS seams, CAST(sum(n) AS BIGINT) AS n FROM (SELECT formation, seam, count(*) AS n FROM gx WHERE bucket <> 'rejected' AND formation IS NOT NULL AND seam IS NOT NULL GROUP BY 1, 2) GROUP BY formation")
def formation_tree(t: Tables) -> DataFrame:
    return E.formation_tree(t.typed).withColumn("seams", F.array_sort(F.transform("seams", lambda s: F.concat_ws(":", s["seam"], s["n"].cast("string")))))


COMPARED = """, base AS MATERIALIZED (SELECT * FROM gx WHERE bucket = 'verified' AND document_id IN ('doc1', 'doc3')),
vals AS MATERIALIZED (SELECT document_id, 'formations' AS category, formation AS item, CAST(NULL AS DOUBLE) AS value FROM base WHERE formation IS NOT NULL GROUP BY ALL
 UNION ALL SELECT document_id, 'seams', seam, NULL FROM base WHERE seam IS NOT NULL GROUP BY ALL UNION ALL SELECT document_id, 'boreholes', borehole_key, NULL FROM base GROUP BY ALL
 UNION ALL SELECT document_id, 'resources', seam, arg_min(value_num, row(source_page, id)) FROM base WHERE kind = 'resource_quantity' AND seam IS NOT NULL GROUP BY ALL
 UNION ALL SELECT document_id, 'borehole_depths', borehole_key, arg_min(metres, row(source_page, id)) FROM base WHERE kind = 'borehole_depth' GROUP BY ALL
 UNION ALL SELECT document_id, 'minimum_workable_thickness', kind, arg_min(metres, row(source_page, id)) FROM base WHERE kind = 'minimum_workable_seam_thickness' GROUP BY ALL)"""


@query(COMPARED + " SELECT coalesce(a.category, b.category) AS category, coalesce(a.item, b.item) AS item, a.value AS a_value, a.item IS NOT NULL AS in_a, b.value AS b_value, b.item IS NOT NULL AS in_b FROM (SELECT * FROM vals WHERE document_id = 'doc1') a FULL JOIN (SELECT * FROM vals WHERE document_id = 'doc3') b ON a.category = b.category AND a.item = b.item")
def compare_documents(t: Tables) -> DataFrame:
    return E.compare_documents(t.typed, "doc1", "doc3")


# Corpus --------------------------------------------------------------------------------------------------------

CUES = {"en": {"the": 1.0, "of": 1.0, "and": 0.5}, "de": {"der": 1.0, "und": 1.0, "die": 0.5}, "fr": {"les": 1.0, "des": 1.0, "une": 0.5}, "es": {"los": 1.0, "las": 1.0, "una": 0.5}}
_SCORE = {n: " + ".join(f"least(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w = '{w}')), 8) * CAST({x} AS DOUBLE)" for w, x in words.items()) for n, words in CUES.items()}


@query("SELECT document_id, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in _SCORE.items()) + " FROM {v_page} p")
def cue_scores(t: Tables) -> DataFrame:
    return C.cue_counts(t.page, CUES)


_LIST = ", ".join(f"(-round({s}, 6), '{n}')" for n, s in _SCORE.items())


@query(f"""SELECT document_id, CASE WHEN fine THEN name ELSE 'other' END AS domain, top AS score, CASE WHEN fine THEN round(least(0.97, 0.45 + 0.35 * top / greatest(total, 1e-6) + 0.25 * (top - second) / greatest(top, 1e-6)), 3) WHEN top > 0 THEN 0.35 ELSE 0.2 END AS confidence
FROM (SELECT document_id, x[1][2] AS name, -x[1][1] AS top, -x[2][1] AS second, -x[1][1] - x[2][1] - x[3][1] - x[4][1] AS total, -x[1][1] >= 2.5 AS fine FROM (SELECT document_id, list_sort([{_LIST}]) AS x FROM {{v_page}} p))""")
def domain_classes(t: Tables) -> DataFrame:
    return C.classify(t.page, CUES)


@query()
def document_chunks(t: Tables) -> DataFrame:
    return C.chunks(t.page)


TOPICS = {"licences": ["licensed", "copyright"], "mail": ["@", "mailto"], "numbers": ["2019", "2020", "2021"]}


@query("""SELECT topic, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM (SELECT document_id, 'licences' AS topic FROM {v_page} p WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'copyright') UNION ALL SELECT document_id, 'mail' FROM {v_page} p WHERE contains(text, '@') OR contains(lower(text), 'mailto')
UNION ALL SELECT document_id, 'numbers' FROM {v_page} p WHERE contains(text, '2019') OR contains(text, '2020') OR contains(text, '2021')) GROUP BY topic""")
def topic_counts(t: Tables) -> DataFrame:
    return C.topic_counts(C.topics(t.page.select("document_id", F.col("document_id").alias("chunk_id"), F.col("text").alias("content")), TOPICS)).select("topic", "documents", "chunks")


@query("SELECT id, entity_name, CAST(value AS DOUBLE) AS value, period, field FROM fx", whole=True)
def facts_from_sentences(t: Tables) -> DataFrame:
    return C.parse_sentences(C.fact_sentences(t.fact)).select("id", "entity_name", "value", "period", "field")


#: wx: the unit vectors of the facts' sentences, from the grams and their md5 digests.
VECTORS = r""", said AS MATERIALIZED (SELECT id, list_transform(regexp_extract_all(lower(entity_name || ' produced ' || value || ' ' || coalesce(unit, 'units') || ' during ' || financial_year || ' (' || field_name || ').'), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END) AS w FROM vf),
grams AS (SELECT id, unnest(w) AS g FROM said UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM said UNION ALL SELECT id, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) FROM (SELECT id, unnest(w) AS x FROM said) UNION ALL SELECT id, unnest(list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4))) FROM (SELECT id, unnest(w) AS x FROM said)),
digest AS MATERIALIZED (SELECT g, CAST(('0x' || md5(g))::UHUGEINT % 768 AS INT) AS rest FROM (SELECT DISTINCT g FROM grams)),
summed AS (SELECT id, rest % 384 AS idx, sum(CASE WHEN rest < 384 THEN 1 + ln(1 + length(g)) ELSE -1 - ln(1 + length(g)) END) AS w FROM grams JOIN digest USING (g) GROUP BY 1, 2 HAVING round(w, 9) <> 0),
wx AS MATERIALIZED (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM summed)"""


@query(VECTORS + " SELECT id, CAST(idx AS INT) AS idx, round(w, 6) AS weight, (SELECT count(*) FROM fx) AS facts FROM wx")
def hashed_embeddings(t: Tables) -> DataFrame:
    count = t.fact.agg(F.count("*").alias("facts"))
    return C.embeddings(C.fact_sentences(t.fact), "id").withColumn("weight", F.round("weight", 6)).join(F.broadcast(count))  # one row


@query("""SELECT document_id, entity_name, CASE field WHEN 'production_target' THEN 'target' ELSE 'during' END AS measure, period, CAST(value AS DOUBLE) AS value FROM fx WHERE field IN ('production', 'production_target')""")
def facts_from_tables(t: Tables) -> DataFrame:
    f = t.fact.where("field_name in ('production', 'production_target')").select("document_id", "entity_name", "financial_year", "field_name", "value")
    col = 2 + 2 * (F.substring("financial_year", 3, 4).cast("int") - 1990) + F.when(F.col("field_name") == "production", 0).otherwise(1)
    cell = lambda df, row, c, text: df.select("document_id", F.lit(0).alias("table_no"), row.cast("int").alias("row_no"), c.cast("int").alias("col_no"), text.alias("text"))
    mine = F.substring("entity_name", 6, 9).cast("int") + 2
    heads = f.select("document_id", "financial_year", "field_name").distinct()
    top = cell(heads, F.lit(0), col, F.when(F.col("field_name") == "production", "Production during Mar").otherwise("Monthly Target"))
    sub = cell(heads, F.lit(1), col, F.concat(F.lit("FY "), F.substring("financial_year", 5, 2)))
    labels = cell(f.select("document_id", "entity_name").distinct(), mine, F.lit(1), F.col("entity_name"))
    return C.table_facts(top.unionByName(sub).unionByName(labels).unionByName(cell(f, mine, col, F.col("value")))).withColumn("period", F.when(F.col("period") > "FY2089", F.concat(F.lit("FY19"), F.substring("period", 5, 2))).otherwise(F.col("period"))).select("document_id", "entity_name", "measure", "period", "value")


# Retrieval -----------------------------------------------------------------------------------------------------


@query("""SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS INT) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10 AND round(score, 9) >= 0.28""")
def vector_top_k(t: Tables) -> DataFrame:
    """The nearest of every hundredth row that reach the floor of a search."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.exact_top_k(rows.where("id % 100 = 0"), rows, 10, R.LEAST_SCORE).withColumn("score", F.round("score", 6))


@query("""SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS INT) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def vector_top_k_of_hundredth(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.exact_top_k(rows.where("id % 100 = 0"), rows, 10, -1.0).withColumn("score", F.round("score", 6))


@query(VECTORS + """, qx AS MATERIALIZED (SELECT * FROM wx WHERE id IN (SELECT id FROM fx WHERE CAST('0x' || left(md5(id), 8) AS BIGINT) % 100 = 0))
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM (SELECT q.id AS query_id, v.id AS id, round(sum(q.w * v.w), 6) AS score FROM qx q JOIN wx v ON q.idx = v.idx GROUP BY q.id, v.id) QUALIFY rank <= 10""")
def sparse_top_k(t: Tables) -> DataFrame:
    ensure_checkpoints(t.spark)
    vectors = C.embeddings(C.fact_sentences(t.fact), "id").checkpoint()  # read as queries and as rows
    asked = t.fact.where(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 100 == 0).select("id")  # one fact in a hundred, as for the other searches
    return R.sparse_top_k(vectors.join(asked, "id", "left_semi"), vectors)


SPECS = "(VALUES (1, 'mine 7', 'coal', 'FY1997-98', 'march', 'actual'), (2, NULL, 'Output', 'FY1996-97', NULL, NULL), (3, 'Mine 12', 'lignite', NULL, NULL, 'target'))"


def _specs(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM {SPECS} AS s(spec_id, entity, metric, period, month, measure)")


@query(f""", spec AS (SELECT spec_id, lower(entity) AS e, CASE metric WHEN 'Output' THEN 'production' ELSE metric END AS m, period AS p, month AS mo, CASE measure WHEN 'actual' THEN 'during' ELSE measure END AS k FROM {SPECS} s(spec_id, entity, metric, period, month, measure)),
hit AS (SELECT spec_id, fact_id, document_id, round(CAST(1.45 AS DOUBLE) + CASE WHEN e IS NULL THEN 0 ELSE 0.35 END + CASE WHEN p IS NULL THEN 0 WHEN period = p THEN 0.2 ELSE -0.15 END + CASE WHEN mo IS NULL THEN 0 WHEN coalesce(lower(reporting_month) = mo, false) THEN 0.25 ELSE 0 END + CASE WHEN k IS NULL THEN 0 WHEN coalesce(measure = k, false) THEN 0.15 ELSE 0 END, 6) AS score
 FROM cx JOIN spec ON storage_metric = m WHERE e IS NULL OR lower(entity_name) = e)
SELECT spec_id, fact_id, score, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, fact_id) AS INT) AS rank FROM hit QUALIFY rank <= 5""")
def fact_evidence(t: Tables) -> DataFrame:
    return R.best_evidence(R.compatible(t.classified, _specs(t))).select("spec_id", "fact_id", "score", "rank")


@query("""SELECT 1 AS spec_id, s.entity, s.field, s.period, count(u.id) AS n, arg_max(u.base_value, (u.confidence_score, u.id)) AS value FROM (SELECT DISTINCT entity, f.field, p.period FROM fx, (SELECT unnest(['production', 'dispatch']) AS field) f, (SELECT unnest(['FY1995', 'FY1997', 'FY2050']) AS period) p) s LEFT JOIN ux u ON s.entity = u.entity AND s.field = u.field AND s.period = u.period GROUP BY ALL""")
def filled_slots(t: Tables) -> DataFrame:
    spec = t.fact.select(F.array("entity_name").alias("entities")).distinct().select(F.lit(1).alias("spec_id"), "entities", F.array(F.lit("output"), F.lit("dispatch")).alias("metrics"), F.array(F.lit("FY 1995"), F.lit("1997"), F.lit("FY2050")).alias("periods"))
    return R.fill_slots(spec, t.usable).select("spec_id", "entity", "field", "period", "n", "value")


@query("""SELECT phrase, document_id, round(CAST(0.75 AS DOUBLE) * n / 2 + CAST(0.25 AS DOUBLE) * n / 2 + 0.15, 6) AS score, CAST(row_number() OVER (PARTITION BY phrase ORDER BY n DESC, document_id) AS INT) AS rank
FROM (SELECT c.phrase, u.document_id, 1 + CAST(split_part(u.filename, '_', 2) = c.num || '.pdf' AS INT) AS n FROM {v_upload} u JOIN (SELECT 'file ' || n AS phrase, n AS num FROM (SELECT DISTINCT CAST(o_custkey % 3 AS VARCHAR) AS n FROM orders)) c ON true) QUALIFY rank <= 3""")
def resolved_documents(t: Tables) -> DataFrame:
    phrases = t.orders.select(F.concat(F.lit("File "), (F.col("o_custkey") % 3).cast("string")).alias("phrase")).distinct()
    return R.resolve_documents(phrases, t.upload).withColumn("phrase", F.lower("phrase"))


@query("SELECT v.id, CASE WHEN c.document_id IS NOT NULL THEN 'CONFLICT' WHEN v.status IN ('high_confidence', 'approved', 'corrected') THEN 'VERIFIED' ELSE 'EVIDENCE' END AS tag FROM fx v LEFT JOIN (SELECT DISTINCT document_id FROM fx WHERE unit IS NULL) c ON v.document_id = c.document_id", whole=True)
def tagged_evidence(t: Tables) -> DataFrame:
    conflicts = t.fact.where("unit is null").select("document_id", F.lit(None).cast("int").alias("page"), N.fingerprint(F.col("id")).alias("fingerprint"))
    return R.tagged(t.fact.withColumnRenamed("page_number", "page"), conflicts).select("id", "tag")


# Stewardship ---------------------------------------------------------------------------------------------------


@query("SELECT id AS fact_id, 'pending' AS status, CAST(CASE WHEN confidence_score < 0.5 THEN 3 WHEN confidence_score < 0.7 THEN 2 ELSE 1 END AS INT) AS priority FROM fx WHERE status = 'review_required'", whole=True)
def review_queue(t: Tables) -> DataFrame:
    return W.queue(t.fact)


#: Reviewers act on the facts of an entity; items exist for the facts of documents 0 to 3, and for some that have gone.
ACTS = """, acts AS (SELECT f.id, a.action, a.corrected_value, a.reviewer, a.acted_at FROM fx f JOIN (SELECT * FROM {v_review} r QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY acted_at, seq) = 1) a ON f.entity_name = a.entity_name)"""


def _actions(t: Tables) -> DataFrame:
    """The first action on each entity, for each of its facts: later ones find the item settled."""
    first = X.one_per(t.review, ["entity_name"], ["acted_at", "seq"])
    return t.fact.select(F.col("id").alias("fact_id"), "entity_name").join(first, "entity_name")


@query(ACTS + " SELECT f.id, CASE WHEN f.status = 'review_required' AND action = 'approve' THEN 'approved' WHEN f.status = 'review_required' AND action = 'reject' THEN 'rejected' WHEN f.status = 'review_required' AND action = 'correct' THEN 'corrected' ELSE f.status END AS status, CASE WHEN f.status = 'review_required' AND action = 'correct' THEN corrected_value ELSE numeric_value END AS numeric_value, numeric_value AS original_value, CAST(CASE WHEN f.status = 'review_required' AND action = 'correct' THEN 2 ELSE 1 END AS INT) AS fact_version FROM fx f LEFT JOIN acts a ON f.id = a.id", whole=True)
def reviewed_facts(t: Tables) -> DataFrame:
    return W.apply_actions(t.fact, _actions(t))


@query(ACTS + " SELECT f.id, numeric_value AS original_value, corrected_value, reviewer, acted_at FROM fx f JOIN acts a ON f.id = a.id WHERE f.status = 'review_required' AND action = 'correct'", whole=True)
def correction_history(t: Tables) -> DataFrame:
    return W.history(t.fact, _actions(t))


@query(""", items AS (SELECT id AS fact_id, CASE WHEN page_number = 1 THEN 'done' ELSE 'pending' END AS status, 2 AS priority FROM fx WHERE document_id <= 'doc3' UNION ALL SELECT 'gone/' || id, 'pending', 2 FROM fx WHERE document_id = 'doc4')
SELECT f.id AS fact_id, CASE WHEN f.status = 'review_required' AND coalesce(i.status, 'pending') = 'pending' THEN 'pending' WHEN i.status = 'pending' THEN 'closed' ELSE i.status END AS status, CAST(coalesce(i.priority, CASE WHEN confidence_score < 0.5 THEN 3 WHEN confidence_score < 0.7 THEN 2 ELSE 1 END) AS INT) AS priority
FROM fx f LEFT JOIN items i ON f.id = i.fact_id WHERE f.status = 'review_required' OR i.status IS NOT NULL""")
def synchronized_queue(t: Tables) -> DataFrame:
    items = t.fact.where("document_id <= 'doc3'").select(F.col("id").alias("fact_id"), F.when(F.col("page_number") == 1, "done").otherwise("pending").alias("status"), F.lit(2).alias("priority"))
    gone = t.fact.where("document_id = 'doc4'").select(F.concat(F.lit("gone/"), "id").alias("fact_id"), F.lit("pending").alias("status"), F.lit(2).alias("priority"))
    return W.synchronize(t.fact, items.unionByName(gone))


@query("SELECT document_id, filename, CAST(row_number() OVER (PARTITION BY filename ORDER BY created_at, document_id) AS INT) AS version, lag(document_id) OVER (PARTITION BY filename ORDER BY created_at, document_id) AS replaces FROM {v_upload} u")
def version_chain(t: Tables) -> DataFrame:
    return W.version_numbers(t.upload).select("document_id", "filename", "version", "replaces")


@query("SELECT document_id, first_value(document_id) OVER (PARTITION BY filename ORDER BY created_at, document_id) AS root FROM {v_upload} u")
def version_roots(t: Tables) -> DataFrame:
    ensure_checkpoints(t.spark)
    return W.version_roots(W.version_numbers(t.upload))


@query("SELECT document_id, count(*) AS facts, arg_min(page_number || '|' || id, (page_number, id)) AS first_fact FROM fx GROUP BY document_id", whole=True)
def document_details(t: Tables) -> DataFrame:
    found = V.cross_document(t.fact, t.document).select(F.col("a_id").alias("fact_id"), "fingerprint", F.lit("review_required").alias("status"))
    rows = W.detail(t.document, t.fact, found).where("fact is not null").groupBy("document_id").agg(F.count("*").alias("facts"), F.min(F.struct("fact.page_number", "fact.id")).alias("first"))
    return rows.select("document_id", "facts", F.concat_ws("|", F.col("first.page_number").cast("string"), F.col("first.id")).alias("first_fact"))


# Evidence and reports -------------------------------------------------------------------------------------------


@query("SELECT document_id, count(*) AS facts, count(*) FILTER (status = 'high_confidence') AS high, count(*) FILTER (status = 'review_required') AS review, round(avg(confidence_score), 3) AS confidence FROM fx GROUP BY document_id", whole=True)
def extraction_stats(t: Tables) -> DataFrame:
    return D.job_stats(t.fact)


@query("SELECT f.id, d.filename, d.version, CASE WHEN f.status IN ('high_confidence', 'approved', 'corrected') THEN 'Verified.' WHEN f.status = 'rejected' THEN 'Rejected by a reviewer.' ELSE 'Pending human review.' END AS note FROM fx f LEFT JOIN {v_document} d ON f.document_id = d.document_id", whole=True)
def fact_details(t: Tables) -> DataFrame:
    return D.fact_detail(t.fact, t.document).select("id", "filename", "version", "note")


@query("SELECT id, (SELECT count(*) FROM fx WHERE contains(lower(entity_name), 'mine 1')) AS total FROM fx WHERE contains(lower(entity_name), 'mine 1') ORDER BY period DESC, id LIMIT 50 OFFSET 50")
def browsed_facts(t: Tables) -> DataFrame:
    rows = X.normalized(t.fact).where(X.contains_ci("entity_name", "Mine 1"))
    return D.page_of(rows.select("id", "period"), [F.desc("period"), "id"], 50, 50).select("id", "total")


@query("""SELECT id, document_id, borehole_key, metres FROM gx WHERE bucket <> 'rejected' AND kind = 'borehole_depth' QUALIFY row_number() OVER (PARTITION BY document_id, borehole_key, value_num ORDER BY CASE bucket WHEN 'verified' THEN 0 ELSE 1 END, source_page, id) = 1""")
def borehole_evidence(t: Tables) -> DataFrame:
    depths = D.geological_evidence(t.typed, "borehole_depth")  # this query's SQL lists each depth of a borehole once
    return X.one_per(depths, ["document_id", "borehole_key", "value_num"], [F.when(F.col("bucket") == "verified", 0).otherwise(1), "source_page", "id"]).select("id", "document_id", "borehole_key", "metres")


@query("""SELECT id, document_id, seam, borehole_key, metres FROM gx WHERE bucket <> 'rejected' AND kind = 'borehole_depth' QUALIFY row_number() OVER (PARTITION BY document_id, kind, seam, borehole_key, value_num, source_page, status ORDER BY CASE bucket WHEN 'verified' THEN 0 ELSE 1 END, source_page, id) = 1""")
def measured_evidence(t: Tables) -> DataFrame:
    return D.geological_evidence(t.typed, "borehole_depth").select("id", "document_id", "seam", "borehole_key", "metres")


@query("SELECT id, seam, metres FROM gx WHERE kind = 'seam_thickness' AND seam IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seam ORDER BY CASE bucket WHEN 'verified' THEN 0 ELSE 1 END, value_num DESC, id) = 1")
def best_seam_thickness(t: Tables) -> DataFrame:
    return D.best_thickness(t.typed.withColumns({"value_max": F.lit(None).cast("double"), "confidence": F.col("value_num")})).select("id", "seam", "metres")


@query("SELECT document_id, avg(length(trim(text))) < 400 AS is_scanned FROM {v_page} p GROUP BY document_id")
def scanned_documents(t: Tables) -> DataFrame:
    return Y.scanned(t.page, 400.0).select("document_id", "is_scanned")


@query("""SELECT 1 AS spec_id, id AS document_id, round(CAST(1.6 AS DOUBLE) + CASE WHEN period = 'FY1997' THEN 0.2 ELSE -0.15 END, 6) AS score FROM fx WHERE entity = 'mine 7'""")
def text_evidence(t: Tables) -> DataFrame:
    spec = t.spark.sql("SELECT 1 AS spec_id, 'the Mine 7' AS entity, 'output' AS metric, 'FY1997' AS period, CAST(NULL AS STRING) AS month")
    rows = t.fact.select(F.col("id").alias("document_id"), F.concat_ws(" ", "entity_name", F.lit("production in"), "financial_year").alias("content"))
    return D.text_compatible(rows, spec).select("spec_id", "document_id", "score")


@query("""SELECT period AS spec_id, CASE WHEN count(DISTINCT lower(coalesce(unit, ''))) > 1 THEN 'unit_mismatch' ELSE 'ok' END AS status, CASE WHEN count(DISTINCT lower(coalesce(unit, ''))) = 1 THEN arg_max(entity, (numeric_value, entity)) END AS higher FROM px WHERE field = 'production' GROUP BY period""", whole=True)
def comparison_verdicts(t: Tables) -> DataFrame:
    rows = A.trend(t.usable).where("field = 'production'").select(F.col("period").alias("spec_id"), F.col("entity").alias("label"), F.col("numeric_value").alias("value"), "unit", F.lit(False).alias("conflict"))
    return D.compared(rows).select("spec_id", "status", "higher")


@query("SELECT bucket, count(*) AS n FROM gx GROUP BY bucket")
def report_review_status(t: Tables) -> DataFrame:
    u = t.usable
    return D.report_parts(A.trend(u), A.actual_vs_target(u), A.compare_entities(u), t.fact, t.conflict, t.typed)["Audit_Review_Status"]


@query("SELECT document_id FROM fx UNION SELECT document_id FROM gx WHERE bucket <> 'rejected'")
def report_sources(t: Tables) -> DataFrame:
    u = t.usable
    return D.report_parts(A.trend(u), A.actual_vs_target(u), A.compare_entities(u), t.fact, t.conflict, t.typed)["Evidence_Sources"]


@query("SELECT document_id, formation FROM gx WHERE formation IS NOT NULL GROUP BY ALL")
def formations_in_texts(t: Tables) -> DataFrame:
    said = t.geo.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("geological_formation")), ". We met the ").alias("text"))
    return D.formations_in(said.withColumn("text", F.concat(F.lit("Above the "), "text")))


@query("SELECT document_id, content_type, count(*) AS n FROM (SELECT document_id, 'structured_fact' AS content_type FROM ix UNION ALL SELECT document_id, 'verified_fact' FROM ver UNION ALL SELECT document_id, 'text' FROM fx) GROUP BY ALL", whole=True)
def corpus_index(t: Tables) -> DataFrame:
    text = t.fact.select("document_id", F.col("id").alias("content"))
    rows = D.index_rows(text, t.index.select("document_id", F.col("chunk_id").alias("content")), C.fact_sentences(X.verified(t.fact)).select("document_id", "content"))
    return rows.groupBy("document_id", "content_type").agg(F.count_distinct("chunk_id").alias("n"))


# More evidence -------------------------------------------------------------------------------------------------


@query("SELECT document_id, value_num AS latitude, CAST(source_page * 20 AS DOUBLE) AS longitude FROM gx QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY source_page, id) = 1")
def document_locations(t: Tables) -> DataFrame:
    rows = t.typed.withColumn("evidence_text", F.concat(F.lit("hole at Latitude: "), F.col("value_num").cast("string"), F.lit(", Longitude: "), (F.col("source_page") * 20).cast("string")))
    return E.locations(rows, t.document.select("document_id", F.lit(None).cast("string").alias("meta_text")))


@query("SELECT document_id, entity_name, period, field, value, 'MT' AS unit FROM (SELECT id AS document_id, entity_name, period, unnest(['production', 'production_target']) AS field, unnest([CAST(value AS DOUBLE), CAST(value AS DOUBLE) + 1]) AS value FROM fx)")
def facts_from_prose(t: Tables) -> DataFrame:
    more = (F.col("value").cast("long") + 1).cast("string")
    text = F.concat(F.col("entity_name"), F.lit(" produced "), F.col("value"), F.lit(" MT during "), F.col("financial_year"), F.lit(" against a target of "), more, F.lit(" MT."))
    return T.production_facts(t.fact.select(F.col("id").alias("document_id"), text.alias("text")))


@query("SELECT id AS document_id, metric_kind, 'Seam ' || seam_name AS seam_name, borehole_id, value_num + CASE metric_kind WHEN 'seam_thickness' THEN 0 ELSE 1 END AS value FROM (SELECT id, unnest(['seam_thickness', 'borehole_depth']) AS metric_kind, seam_name, borehole_id, value_num FROM gx WHERE seam_name IS NOT NULL)")
def geological_facts_from_prose(t: Tables) -> DataFrame:
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    text = say("Borehole ", F.col("borehole_id"), " met Seam ", F.col("seam_name"), " with a thickness of ", F.col("value_num").cast("int"), " m and a depth of ", F.col("value_num").cast("int") + 1, " m.")
    pages = t.geo.where("seam_name is not null").select(F.col("id").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))
    return C.geological_facts(pages).select("document_id", "metric_kind", "seam_name", "borehole_id", "value")


SCORED = """CAST(0.55 + 0.12 + 0.12 + CASE WHEN page_number <> 3 THEN 0.10 ELSE 0 END + CASE WHEN unit IS NULL THEN 0 ELSE 0.05 END + 0.04 + 0.03 + CASE WHEN field = 'dispatch' THEN -0.15 ELSE 0.06 END - CASE WHEN page_number = 2 THEN 0.22 ELSE 0 END
 - CASE WHEN page_number = 1 THEN 0.10 + CASE WHEN CAST(value AS BIGINT) % 2 = 0 THEN 0.12 + 0.08 ELSE 0 END + CASE WHEN confidence_score < 0.5 THEN 0.12 + 0.10 WHEN confidence_score < 0.75 THEN 0.12 ELSE 0 END ELSE 0 END
 + CASE WHEN page_number <> 3 THEN 0.04 ELSE 0 END - CASE WHEN page_number = 1 AND confidence_score < 0.8 THEN 0.05 ELSE 0 END AS DOUBLE)"""


@query(f"SELECT id, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), round({SCORED}, 3))) AS score, CASE WHEN round({SCORED}, 3) >= 0.85 THEN 'high_confidence' ELSE 'review_required' END AS status FROM fx")
def draft_scores(t: Tables) -> DataFrame:
    yes, mean = F.lit(True), F.col("confidence_score") * 100
    evidence = F.concat(F.lit("Mine told "), F.when(F.col("value").cast("long") % 2 == 0, "what?").otherwise("what."))
    score = T.confidence(F.col("value"), evidence, F.col("unit"), F.col("entity_name"), F.col("financial_year"), F.col("field_name"), F.col("page_number") == 2, F.col("page_number") == 1, F.col("field_name") != "dispatch", F.col("page_number") != 3, mean)
    return t.fact.select("id", score.alias("score"), T.draft_status(score).alias("status"))


@query("SELECT event_id AS id, ts AS created_at, 'type=' || event_type AS details FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def audit_log(t: Tables) -> DataFrame:
    log = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.create_map(F.lit("Password"), F.lit("x"), F.lit("type"), "event_type").alias("details"))
    return W.audit(log).withColumn("details", F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


_WORDS = "SELECT 'doc' || CAST(l_suppkey % 7 AS VARCHAR) AS document_id, CAST(l_partkey % 50 AS INT) AS page_number, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_linenumber <= 2 THEN CAST(l_suppkey AS VARCHAR) || '.' || CAST(l_orderkey % 10 AS VARCHAR) ELSE l_returnflag || CAST(l_orderkey % 50 AS VARCHAR) END AS word, l_quantity * 2 - 4 AS confidence FROM lineitem"


@query(f"""WITH words AS ({_WORDS}), poor AS (SELECT document_id, page_number, word, min(place) AS seen FROM words WHERE confidence BETWEEN 0 AND 69.99 GROUP BY ALL),
a AS (SELECT document_id, page_number, string_agg(word, ' ' ORDER BY seen, word) AS low_words FROM (SELECT * FROM poor QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY seen, word) <= 40) GROUP BY ALL),
b AS (SELECT document_id, page_number, string_agg(word, ' ' ORDER BY seen, word) AS low_decimals FROM (SELECT * FROM poor WHERE contains(word, '.') QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY seen, word) <= 20) GROUP BY ALL)
SELECT document_id, page_number, round(avg(confidence), 3) AS mean_confidence, any_value(low_words) AS low_words, any_value(low_decimals) AS low_decimals FROM words LEFT JOIN a USING (document_id, page_number) LEFT JOIN b USING (document_id, page_number) WHERE confidence >= 0 GROUP BY ALL""")
def recognition_quality(t: Tables) -> DataFrame:
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    word = F.when(line <= 2, F.concat(F.col("l_suppkey").cast("string"), F.lit("."), (order % 10).cast("string"))).otherwise(F.concat("l_returnflag", (order % 50).cast("string")))
    words = t.lineitem.select(F.concat(F.lit("doc"), (F.col("l_suppkey") % 7).cast("string")).alias("document_id"), (F.col("l_partkey") % 50).cast("int").alias("page_number"), (order * 10 + line).alias("place"), word.alias("word"), (F.col("l_quantity") * 2 - 4).alias("confidence"))
    out = Y.page_confidence(words)
    return out.select("document_id", "page_number", "mean_confidence", F.array_join("low_words", " ").alias("low_words"), F.array_join("low_decimals", " ").alias("low_decimals"))


@query("SELECT doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY source, left(regexp_replace(lower(coalesce(text, '')), '[ \t\n\v\f\r]+', ' ', 'g'), 80) ORDER BY doc_id) = 1")
def evidence_without_near_copies(t: Tables) -> DataFrame:
    hits = t.page.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.lit(1).alias("page"), F.col("text").alias("content"), F.lit(1.0).alias("value"), F.lit(1.0).alias("score"))
    return R.without_near_copies(hits).select("id")


@query("SELECT id, tag FROM (SELECT id, 'structured' AS tag, document_id, page_number AS page, value FROM ver UNION ALL SELECT id, 'text', document_id, page_number, value FROM fx WHERE status = 'review_required') QUALIFY row_number() OVER (PARTITION BY document_id, page, value ORDER BY tag, id) = 1", whole=True)
def citations(t: Tables) -> DataFrame:
    rows = t.fact.select("id", "status", F.col("document_id").alias("filename"), F.col("page_number").alias("page"), "value")
    a = X.verified(t.fact).select("id", F.col("document_id").alias("filename"), F.col("page_number").alias("page"), "value").withColumn("tag", F.lit("structured"))
    b = rows.where("status = 'review_required'").drop("status").withColumn("tag", F.lit("text"))
    return R.citations(a, b, b.where("false")).select("id", "tag")


# Sources and sinks ---------------------------------------------------------------------------------------------


@query("SELECT document_id, sheet_name, 'Mine | Page | Value' AS header, count(*) AS row_count FROM (SELECT document_id, financial_year AS sheet_name FROM fx) GROUP BY ALL", whole=True)
def sheet_pages(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("document_id", "financial_year").orderBy("id")
    rows = t.fact.withColumn("row_no", F.row_number().over(w))
    cells = rows.select("document_id", F.col("financial_year").alias("sheet_name"), "row_no", F.posexplode(F.array("entity_name", F.col("page_number").cast("string"), "value")).alias("col_no", "text"))
    heads = t.fact.select("document_id", F.col("financial_year").alias("sheet_name")).distinct().select("*", F.lit(0).alias("row_no"), F.posexplode(F.array(F.lit("Mine"), F.lit("Page"), F.lit("Value"))).alias("col_no", "text"))
    return sheets_to_pages(cells.unionByName(heads)).select("document_id", "sheet_name", F.array_join("columns", " | ").alias("header"), F.col("row_count").cast("long").alias("row_count"))


@query("SELECT chunk_id, document_id, value AS content FROM ix WHERE document_id NOT IN (SELECT document_id FROM ix WHERE document_id >= 'doc4') UNION ALL SELECT chunk_id, document_id, value * 2 FROM ix WHERE document_id >= 'doc4'")
def chunk_upsert(t: Tables) -> DataFrame:
    stored = t.index.select("chunk_id", "document_id", F.col("value").alias("content"), F.lit(1).alias("version"))
    new = stored.where("document_id >= 'doc4'").withColumns({"content": F.col("content") * 2, "version": F.lit(3)})
    return upserted(stored, new.unionByName(new.withColumns({"content": F.col("content") + 1, "version": F.lit(2)}))).select("chunk_id", "document_id", "content")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["trend"](spark, sf_dir)

