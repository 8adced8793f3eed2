"""Queries of the operators whose work stays in proportion to the rows: facets by masks of failed criteria, names by their rarest words, ranges by sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import analytics as A
from lodestone.operators import validate as V
from lodestone.plans.catalog import Tables, query

AXES = ("entity_name", "commodity", "metric", "legacy_metric", "measure", "period", "reporting_month")


def _facets(entity: str | None = None, commodity: str | None = None, metric: str | None = None) -> str:
    """One query for each axis."""
    tests = {"entity_name": f"coalesce(lower(entity_name) = lower('{entity}'), false)" if entity else "true", "commodity": f"coalesce(commodity = '{commodity}', false)" if commodity else "true", "metric": f"coalesce(metric = '{metric}' OR storage_metric = '{metric}', false)" if metric else "true"}
    every = " AND ".join(tests.values())

    def axis(name: str) -> str:
        others = " AND ".join(t for a, t in tests.items() if a != ("metric" if name == "legacy_metric" else name))
        value = "CASE WHEN storage_metric IN ('coal', 'lignite', 'coking_coal', 'production_target') THEN storage_metric END" if name == "legacy_metric" else name
        score = "CAST(sum(CASE WHEN storage_metric IN ('production', 'coal', 'overburden', 'dispatch', 'lignite') THEN 3 ELSE 1 END) AS BIGINT)" if name == "entity_name" else "CAST(NULL AS BIGINT)"
        listed = "true" if name in ("entity_name", "legacy_metric") else f"bool_or({every})"
        return f"SELECT '{name}' AS axis, {value} AS value, count(*) FILTER ({every}) AS n, count(*) FILTER ({others}) AS n_open, {score} AS score, {listed} AS listed FROM cx WHERE {value} IS NOT NULL GROUP BY 2"

    return " UNION ALL ".join(axis(a) for a in AXES)


@query(_facets(), whole=True)
def facets_of_all(t: Tables) -> DataFrame:
    return A.facets(t.classified)


@query(_facets("Mine 7", None, "production"), whole=True)
def facets_of_entity_and_metric(t: Tables) -> DataFrame:
    return A.facets(t.classified, entity=" mine 7", metric="Production")


@query(_facets(None, "coal", "coal"), whole=True)
def facets_of_commodity(t: Tables) -> DataFrame:
    """A commodity's name as a metric reaches the storage metric."""
    return A.facets(t.classified, commodity="Coal", metric="coal")


@query(f""", found AS MATERIALIZED ({_facets("Mine 12", "lignite", None)})
SELECT (SELECT value FROM found WHERE axis = 'entity_name' ORDER BY score DESC, length(value), value LIMIT 1) AS entity,
  coalesce((SELECT value FROM found WHERE axis = 'metric' AND listed AND value IN ('production', 'overburden', 'dispatch') ORDER BY list_position(['production', 'overburden', 'dispatch'], value) LIMIT 1), (SELECT min(value) FROM found WHERE axis = 'metric' AND listed)) AS metric,
  coalesce((SELECT max(value) FROM found WHERE axis = 'commodity' AND listed AND value = 'coal'), (SELECT min(value) FROM found WHERE axis = 'commodity' AND listed)) AS commodity,
  (SELECT value FROM found WHERE axis = 'reporting_month' AND listed AND lower(value) LIKE '%march%' ORDER BY lower(value), value LIMIT 1) AS reporting_month""", whole=True)
def suggested_dimensions(t: Tables) -> DataFrame:
    return A.suggested(A.facets(t.classified, "Mine 12", "lignite"))


#: A mine for each part, by five digits; every fourth one is also known by the field that it shares with another, in documents but the first.
NAMED = "'Mine ' || lpad(CAST(code AS VARCHAR(20)), 5, '0') || CASE WHEN document_id <> 'doc0' AND code % 4 = 0 THEN ' field' || CAST(CAST((code - code % 8) / 8 AS INT) AS VARCHAR(20)) ELSE '' END"


@query(f"""SELECT left(sha256('entity|' || a.field || '|' || a.period || '|' || a.entity || '|' || b.entity), 40) AS fingerprint, a.field, a.period, a.entity AS a_entity, b.entity AS b_entity
FROM (SELECT field, period, entity, list_filter(string_split(entity, ' '), lambda w: length(w) > 1) AS ws, lo, hi FROM (SELECT field_name AS field, financial_year AS period, lower({NAMED}) AS entity, min(document_id) AS lo, max(document_id) AS hi FROM (SELECT *, CAST(substr(entity_name, 6) AS INT) AS code FROM {{v_fact_whole}} v WHERE status <> 'rejected') GROUP BY 1, 2, 3)) a
JOIN (SELECT field, period, entity, list_filter(string_split(entity, ' '), lambda w: length(w) > 1) AS ws, lo, hi, unnest(list_filter(string_split(entity, ' '), lambda w: w <> 'mine')) AS asked FROM (SELECT field_name AS field, financial_year AS period, lower({NAMED}) AS entity, min(document_id) AS lo, max(document_id) AS hi FROM (SELECT *, CAST(substr(entity_name, 6) AS INT) AS code FROM {{v_fact_whole}} v WHERE status <> 'rejected') GROUP BY 1, 2, 3)) b
ON a.field = b.field AND a.period = b.period AND a.entity < b.entity AND (a.ws[2] = b.asked OR a.ws[3] = b.asked)
WHERE (a.lo <> b.hi OR a.hi <> b.lo) AND (len(list_intersect(a.ws, b.ws)) = least(len(a.ws), len(b.ws)) OR len(list_intersect(a.ws, b.ws)) >= 0.6 * greatest(len(a.ws), len(b.ws)))""")
def ambiguous_entities_whole(t: Tables) -> DataFrame:
    facts = Tables(t.spark, t.sf_dir, True).fact.withColumn("code", F.substring("entity_name", 6, 20).cast("int"))
    return V.ambiguous_entities(facts.withColumn("entity_name", F.expr(NAMED.replace("VARCHAR(20)", "STRING"))))


#: Lengths of seams as ranges of a tenth to each side, from verified and provisional rows alike.
@query("""SELECT r.*, n, n_in_document, b.document_id AS nearest_document, b.low AS nearest_low, b.high AS nearest_high, gap, CASE WHEN n_in_document > 0 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT a.seam AS entity_key, a.kind AS metric, a.borehole_key AS borehole, a.document_id, a.low, a.high, count(*) AS n, count(*) FILTER (a.document_id = b.document_id) AS n_in_document,
    min(row(round(CASE WHEN b.low > a.high THEN b.low - a.high ELSE a.low - b.high END, 9), b.low > a.high, b.document_id, CASE WHEN b.low > a.high THEN b.low ELSE -b.low END, CASE WHEN b.low > a.high THEN -b.high ELSE b.high END)) AS best
  FROM ranges a JOIN ranges b ON a.seam = b.seam AND a.kind = b.kind AND a.borehole_key = b.borehole_key AND (a.high + 1e-6 < b.low OR b.high + 1e-6 < a.low) GROUP BY ALL) x,
LATERAL (SELECT x.entity_key, x.metric, x.borehole, x.document_id, x.low, x.high) r, LATERAL (SELECT best[1] AS gap, best[3] AS document_id, abs(best[4]) AS low, abs(best[5]) AS high) b""".replace("FROM (SELECT a.seam", "FROM (WITH ranges AS MATERIALIZED (SELECT DISTINCT seam, kind, borehole_key, document_id, metres * CAST(0.9 AS DOUBLE) AS low, metres * CAST(1.1 AS DOUBLE) AS high FROM gx WHERE kind IN ('seam_thickness', 'minimum_workable_seam_thickness') AND bucket <> 'rejected' AND seam IS NOT NULL AND metres IS NOT NULL) SELECT a.seam", 1))
def range_disagreements(t: Tables) -> DataFrame:
    rows = t.typed.where("kind in ('seam_thickness', 'minimum_workable_seam_thickness') and bucket <> 'rejected' and seam is not null")
    return V.range_disagreements(rows.select(F.col("seam").alias("entity_key"), F.col("kind").alias("metric"), F.col("borehole_key").alias("borehole"), "document_id", (F.col("metres") * 0.9).alias("low"), (F.col("metres") * 1.1).alias("high")))
