"""Queries of answers from facts alone, of a report's datasets, of stored pages and table chunks, and of browsed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.operators import analytics as A
from lodestone.operators import answers as B
from lodestone.operators import corpus as C
from lodestone.operators import evidence as D
from lodestone.operators import report as P
from lodestone.operators.facts import filter_index_facts
from lodestone.plans.catalog import Tables, query
from lodestone.sources.store import page_table

#: Titles of the tables that index facts stand in, by page.
TITLES = {1: "Table 1: Coal Production in MT", 2: "Coal Stock", 3: "Status of Projects", 4: "Coal Dispatch", 5: "All figures in MT", 6: "Table 6: Lignite"}
TITLE_SQL = "CASE page " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TITLES.items()) + " END"
#: What each title is worth for coal, lignite and other metrics.
WORTH = {1: (0.55, 0.1, 0.1), 2: (0.2, 0.0, 0.0), 3: (-0.3, 0.0, 0.0), 4: (-0.15, 0.0, 0.0), 5: (-0.2, -0.2, -0.2), 6: (0.1, 0.55, 0.1)}


def _title() -> Column:
    return F.coalesce(*(F.when(F.col("page") == k, v) for k, v in TITLES.items()))


def _index(t: Tables) -> DataFrame:
    return t.index_facts.withColumnRenamed("chunk_id", "fact_id").withColumn("table_title", _title())


# Facts first -----------------------------------------------------------------------------------------------------


def _worth(column: int) -> str:
    return "CASE page " + " ".join(f"WHEN {k} THEN {v[column]}" for k, v in WORTH.items()) + " ELSE 0 END"


#: Each mine asks in one of six forms; form 4 spells its name without a blank, form 5 asks by name and year alone, and for no number in every other case; two specs ask for a metric of all mines.
FIRST = f"""
, spec AS MATERIALIZED (SELECT spec_id, lower(e1) AS e, CASE form WHEN 0 THEN ['coal'] WHEN 1 THEN ['coal', 'lignite', 'coking_coal'] WHEN 2 THEN ['lignite'] WHEN 3 THEN ['production'] WHEN 4 THEN ['coal'] ELSE [] END AS ms, CASE form WHEN 0 THEN [first_period, last_period] WHEN 2 THEN [last_period] WHEN 5 THEN [last_period] ELSE [] END AS ps,
    CASE form WHEN 0 THEN ['march'] WHEN 4 THEN ['june', 'march'] ELSE [] END AS mos, CASE form WHEN 3 THEN ['target', 'during'] WHEN 0 THEN ['during'] ELSE [] END AS ks FROM {{v_ask}} a WHERE form <> 5 OR spec_id % 12 = 5
  UNION ALL SELECT -1, NULL, ['coal'], [], ['march'], [] UNION ALL SELECT -2, NULL, ['lignite'], [], [], ['during']),
met AS (SELECT s.spec_id, i.chunk_id AS fact_id, i.document_id, CASE WHEN len(ps) > 0 THEN period END AS period,
    1.2 + CASE WHEN e IS NULL THEN 0 ELSE 0.35 END + CASE WHEN len(ms) > 0 THEN 0.25 ELSE 0 END + CASE WHEN len(ps) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(mos) > 0 THEN 0.25 ELSE 0 END + CASE WHEN len(ks) > 0 THEN 0.15 ELSE 0 END AS met,
    CASE WHEN list_contains(ms, 'coal') AND list_contains(ms, 'lignite') THEN {_worth(0)} + CASE page WHEN 6 THEN 0.45 ELSE 0 END WHEN list_contains(ms, 'coal') THEN {_worth(0)} WHEN list_contains(ms, 'lignite') THEN {_worth(1)} ELSE {_worth(2)} END AS title, CASE WHEN len(ps) > 0 THEN 0.92 ELSE 0.9 END AS base
  FROM ix i JOIN spec s ON (e IS NULL OR lower(entity_name) = e)
  WHERE (len(ms) = 0 OR list_contains(ms, metric) OR (list_contains(ms, 'production') AND metric IN ('coal', 'lignite'))) AND NOT (list_contains(ms, 'coal') AND metric = 'lignite') AND (len(ps) = 0 OR list_contains(ps, period)) AND (len(mos) = 0 OR coalesce(list_contains(mos, lower(reporting_month)), false)) AND (len(ks) = 0 OR list_contains(ks, measure)))
SELECT spec_id, fact_id, document_id, period, round(CAST(base + 0.01 * met + title AS DOUBLE), 6) AS score, round(CAST(met + title AS DOUBLE), 6) AS compat, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY title DESC, fact_id) AS INT) AS rank FROM met QUALIFY rank <= 40"""


@query(FIRST, whole=True)
def fact_first_evidence(t: Tables) -> DataFrame:
    form, text = F.col("form"), lambda *xs: F.array(*map(F.lit, xs))
    asks = t.ask.select(
        "spec_id", F.when(form == 4, F.replace(F.col("e1"), F.lit(" "), F.lit("-"))).otherwise(F.col("e1")).alias("entity"), (form.isin(0, 1, 2, 3, 4) | (F.col("spec_id") % 12 == 5)).alias("prefers_numeric"),
        F.when(form.isin(0, 4), text("Coal")).when(form == 1, text("coal", "lignite", "coking_coal")).when(form == 2, text("lignite")).when(form == 3, text("production")).alias("metrics"), F.when(form == 0, F.array("first_period", "last_period")).when(form.isin(2, 5), F.array("last_period")).alias("periods"),
        F.when(form == 0, text("March")).when(form == 4, text("June", "March")).alias("months"), F.when(form == 3, text("target", "during")).when(form == 0, text("during")).alias("measures"))
    wide = t.spark.sql("SELECT * FROM VALUES (-1L, CAST(NULL AS STRING), true, array('coal'), CAST(NULL AS ARRAY<STRING>), array('March'), CAST(NULL AS ARRAY<STRING>)), (-2L, ' ', true, array('lignite'), NULL, NULL, array('during')) AS s(spec_id, entity, prefers_numeric, metrics, periods, months, measures)")
    return B.fact_first(_index(t), asks.unionByName(wide)).drop("reasons")


# Bars and tables -------------------------------------------------------------------------------------------------


def _bars(metric: str) -> str:
    return f"""
, best AS (SELECT lower(entity_name) AS entity, arg_max({{'value': value, 'unit': unit, 'period': period, 'fact_id': fact_id, 'document_id': document_id}}, (source <> 'index' OR coalesce(measure = 'during', false), period, confidence, fact_id)) AS bar FROM cx WHERE storage_metric = '{metric}' AND value IS NOT NULL GROUP BY 1),
open AS (SELECT DISTINCT lower(entity_name) AS entity FROM {{v_conflict}} c WHERE status = 'review_required' AND field_name = '{metric}'),
bars AS (SELECT a.entity, bar, CASE WHEN o.entity IS NOT NULL THEN 'conflict' WHEN bar IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT entity FROM fx UNION SELECT 'mine x') a LEFT JOIN best b ON a.entity = b.entity LEFT JOIN open o ON a.entity = o.entity),
shown AS (SELECT entity, bar, CASE WHEN status = 'ok' AND (SELECT count(DISTINCT lower(bar.unit)) > 1 FROM bars WHERE status = 'ok') THEN 'withheld' ELSE status END AS status FROM bars)
SELECT entity, status, CASE WHEN status = 'ok' THEN bar.value END AS value, CASE WHEN status = 'ok' THEN bar.unit END AS unit, CASE WHEN status = 'ok' THEN bar.period END AS period, CASE WHEN status = 'ok' THEN bar.fact_id END AS fact_id, CASE WHEN status = 'ok' THEN bar.document_id END AS document_id FROM shown"""


def _asked(t: Tables) -> DataFrame:
    return t.fact.select("entity_name").union(t.spark.sql("SELECT 'Mine X' AS entity_name"))


@query(_bars("production"), whole=True)
def entity_bars(t: Tables) -> DataFrame:
    return B.entity_bars(t.classified, t.conflict, _asked(t), "Output")


@query(_bars("dispatch"), whole=True)
def entity_bars_of_dispatch(t: Tables) -> DataFrame:
    """Extracted facts alone, whose units differ, and entities with open conflicts."""
    return B.entity_bars(t.classified, t.conflict, _asked(t), "dispatch")


@query("""
, deduped AS (SELECT * FROM cx WHERE storage_metric = 'production' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(entity_name), period, round(value, 6), coalesce(measure, '') ORDER BY CASE source WHEN 'index' THEN 0 ELSE 1 END, fact_id) = 1),
flagged AS (SELECT *, bool_or(source = 'index') OVER w AS indexed, bool_or(coalesce(measure = 'during', false)) OVER w AS has_during FROM deduped WINDOW w AS (PARTITION BY lower(entity_name))),
points AS (SELECT lower(f.entity_name) AS entity, period, value, unit, fact_id FROM flagged f WHERE (NOT indexed OR NOT has_during OR coalesce(measure = 'during', false)) AND NOT EXISTS (SELECT 1 FROM openc o WHERE o.entity = lower(f.entity_name) AND o.field = 'production' AND o.period = f.period) QUALIFY row_number() OVER (PARTITION BY lower(entity_name), period ORDER BY confidence DESC, fact_id DESC) = 1),
sides AS (SELECT lower(entity_name) AS entity, metric, period, arg_max(value, (confidence, chunk_id)) FILTER (measure = 'during') AS actual, arg_max(value, (confidence, chunk_id)) FILTER (measure = 'target') AS target, arg_max(chunk_id, (confidence, chunk_id)) FILTER (measure = 'during') AS actual_id FROM ix WHERE metric IN ('production', 'coal', 'lignite') GROUP BY ALL),
chosen AS (SELECT * FROM sides WHERE actual IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY list_position(['production', 'coal', 'lignite'], metric)) = 1),
pairs AS (SELECT entity, period, actual, target, actual_id FROM chosen UNION ALL SELECT a.entity, a.period, a.numeric_value, b.numeric_value, a.id FROM px a JOIN px b ON a.entity = b.entity AND a.period = b.period WHERE a.field = 'production' AND b.field = 'production_target' AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.entity = a.entity AND c.period = a.period)),
origins AS (SELECT chunk_id AS fact_id, document_id, unit, page FROM ix UNION ALL SELECT id, document_id, unit, page_number FROM fx),
rows AS (SELECT coalesce(p.entity, q.entity) AS entity, coalesce(p.period, q.period) AS period, coalesce(q.actual, p.value) AS actual, q.target, round(q.actual / nullif(q.target, 0) * 100, 2) AS achievement, p.unit, coalesce(p.fact_id, q.actual_id) AS fact_id FROM points p FULL JOIN pairs q ON p.entity = q.entity AND p.period = q.period)
SELECT r.entity, r.period, r.actual, r.target, r.achievement, coalesce(r.unit, o.unit) AS unit, r.fact_id, o.document_id, d.filename AS source, o.page FROM rows r LEFT JOIN origins o ON r.fact_id = o.fact_id LEFT JOIN {v_document} d ON o.document_id = d.document_id""", whole=True)
def evidence_table(t: Tables) -> DataFrame:
    rows = t.classified
    points = A.merged_trend(rows, t.conflict).where("storage_metric = 'production'")
    index = t.index_facts.select(F.col("chunk_id").alias("fact_id"), "document_id", "unit", "page")
    origins = index.unionByName(t.fact.select(F.col("id").alias("fact_id"), "document_id", "unit", F.col("page_number").alias("page")))
    return B.evidence_table(points, A.actual_vs_target_merged(rows, t.usable), origins, t.document).drop("note")


# A report's datasets ---------------------------------------------------------------------------------------------


def _told(t: Tables) -> DataFrame:
    """Typed rows with the sentence that tells of each; document 3 has no verified one, document 4 neither resources nor thicknesses."""
    bare = (F.col("document_id") == "doc4") & F.col("kind").isin("resource_quantity", "seam_thickness")
    rows = t.typed.where(~bare & ~((F.col("document_id") == "doc3") & (F.col("bucket") == "verified")))
    return rows.withColumn("evidence_text", F.concat(F.coalesce("seam", F.lit("")), F.lit(" was met in "), F.col("borehole_id"), F.lit(".")))


TOLD = ", told AS MATERIALIZED (SELECT g.*, coalesce(seam, '') || ' was met in ' || borehole_id || '.' AS evidence_text FROM gx g WHERE NOT (document_id = 'doc4' AND kind IN ('resource_quantity', 'seam_thickness')) AND NOT (document_id = 'doc3' AND bucket = 'verified')), named AS (SELECT document_id, filename FROM {v_document} d)"


@query("SELECT entity_name AS entity, metric, value, unit, period, d.filename AS document, i.document_id, page, chunk_id AS fact_id, 'verified_structured' AS status FROM ix i JOIN {v_document} d ON i.document_id = d.document_id", whole=True)
def report_facts_metrics(t: Tables) -> DataFrame:
    return P.facts_metrics(_index(t), t.document)


@query("SELECT DISTINCT entity_name AS entity, field_name AS field, period, status FROM {v_conflict} c WHERE status = 'review_required'", whole=True)
def report_open_conflicts(t: Tables) -> DataFrame:
    return P.validation_conflicts(t.conflict).drop("severity", "description")


@query(TOLD + " SELECT id AS fact_id, kind AS metric_kind, seam, formation, borehole_id AS borehole, value_num AS value, length_unit AS unit, status, filename AS document, t.document_id, source_page AS page, bucket = 'review_required' AS requires_review FROM told t JOIN named d ON t.document_id = d.document_id WHERE bucket <> 'rejected'")
def report_geology(t: Tables) -> DataFrame:
    return P.geological_facts(_told(t), t.document)


@query(TOLD + " SELECT seam, value_num AS value, length_unit AS unit, source_page AS page, status, filename AS document, id AS fact_id FROM (SELECT *, bool_or(bucket = 'verified') OVER (PARTITION BY document_id) AS certain FROM told WHERE bucket <> 'rejected' AND kind IN ('resource_quantity', 'reserve_quantity')) t JOIN named d ON t.document_id = d.document_id WHERE NOT certain OR bucket = 'verified'")
def report_resources(t: Tables) -> DataFrame:
    return P.resources(_told(t), t.document)


@query(TOLD + """ SELECT id AS fact_id, filename AS document, t.document_id, source_page AS page, CASE bucket WHEN 'verified' THEN 'Verified' ELSE 'Needs review' END AS status, kind AS metric, value_num AS value, evidence_text AS evidence
FROM (SELECT * FROM told WHERE bucket <> 'rejected' ORDER BY document_id, source_page, id LIMIT 500) t JOIN named d ON t.document_id = d.document_id""")
def report_evidence_sources(t: Tables) -> DataFrame:
    return P.evidence_sources(_told(t), t.document)


@query(TOLD + """, each AS (SELECT document_id, count(*) AS n, count(*) FILTER (bucket = 'verified') AS v, count(*) FILTER (kind = 'resource_quantity') AS r, count(*) FILTER (kind = 'resource_quantity' AND bucket = 'verified') AS rv, count(*) FILTER (kind = 'seam_thickness') AS t FROM told WHERE bucket <> 'rejected' GROUP BY ALL)
SELECT w.document_id, filename AS document, warning FROM (SELECT document_id, 'structured geological facts pending human verification.' AS warning FROM each WHERE v = 0 UNION ALL SELECT document_id, 'resource analytics pending verification.' FROM each WHERE r > 0 AND rv = 0 UNION ALL SELECT document_id, 'no compatible resource evidence.' FROM each WHERE r = 0 UNION ALL SELECT document_id, 'no compatible seam-thickness evidence.' FROM each WHERE t = 0) w JOIN named d ON w.document_id = d.document_id""")
def report_warnings(t: Tables) -> DataFrame:
    return P.warnings(_told(t), t.document)


@query(TOLD + """, counts AS (SELECT (SELECT count(*) FROM (SELECT document_id FROM ix UNION SELECT document_id FROM told WHERE bucket <> 'rejected')) AS documents, (SELECT count(*) FROM ix) AS fact_count, count(*) FILTER (bucket <> 'rejected') AS geo_fact_count, count(*) FILTER (bucket = 'review_required') AS review_required_count,
  count(*) FILTER (bucket = 'rejected') AS rejected_excluded, CAST(count(*) FILTER (bucket = 'review_required') > 0 AS BIGINT) AS pending_verification, (SELECT count(*) FROM {v_conflict} c WHERE status = 'review_required') AS open_conflicts FROM told)
SELECT field, CAST(n AS VARCHAR) AS value FROM counts UNPIVOT (n FOR field IN (documents, fact_count, geo_fact_count, review_required_count, rejected_excluded, pending_verification, open_conflicts)) UNION ALL SELECT 'title', 'Combined report' UNION ALL SELECT 'domain', 'combined'""", whole=True)
def report_summary(t: Tables) -> DataFrame:
    return P.summary(_index(t), _told(t), t.conflict)


# Pages, chunks and browsing --------------------------------------------------------------------------------------


@query("""SELECT document_id, 1 AS page_number, text, 'page 1' AS source_location, length(text) AS char_count FROM {v_report_page} p WHERE form <> 5
UNION ALL SELECT document_id, n, 'Old text of page ' || n, 'page ' || n, 18 FROM {v_report_page} p, (VALUES (1), (2)) v(n) WHERE form = 5""")
def stored_pages(t: Tables) -> DataFrame:
    """Two old pages of each document; all but those of one form come again with one page."""
    pages = t.report_page
    n = F.col("n").cast("string")
    old = page_table(pages.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("document_id", F.col("n").alias("page_number"), F.concat(F.lit("Old text of page "), n).alias("text")))
    return page_table(pages.where("form <> 5"), old).select("document_id", "page_number", "text", "source_location", "char_count")


@query(f"""SELECT i.document_id, d.filename AS document_name, d.version AS document_version, page AS page_number, 'page ' || page || ' / t' || page || ' / ' || fiscal_year AS source_location, token_count, content, CAST(row_number() OVER (PARTITION BY i.document_id, page ORDER BY content) - 1 AS INT) AS chunk_index
FROM (SELECT *, len(string_split(content, ' ')) AS token_count FROM (SELECT *, 'STRUCTURED_FACT | entity=' || entity || ' | metric=' || metric || ' | reporting_period=' || coalesce(reporting_month, 'Unknown') || ' | measure=' || measurement_type || ' | fiscal_year=' || fiscal_year || ' | value=' || format('{{:g}}', value) || ' | unit=MT | table=' || coalesce({TITLE_SQL}, 't' || page) || ' | page=' || page || ' | column=' || fiscal_year AS content FROM {{v_index}} v)) i JOIN {{v_document}} d ON i.document_id = d.document_id""", whole=True)
def table_fact_chunks(t: Tables) -> DataFrame:
    facts = t.index.withColumns({"table_id": F.concat(F.lit("t"), F.col("page").cast("string")), "table_title": _title(), "column_path": F.col("fiscal_year")})
    return C.structured_chunks(facts, t.document).select("document_id", "document_name", "document_version", "page_number", "source_location", "token_count", "content", "chunk_index")


@query("SELECT chunk_id, entity_name, period, value, (SELECT count(*) FROM ix WHERE metric = 'coal' AND measure = 'during') AS total FROM ix WHERE metric = 'coal' AND measure = 'during' ORDER BY entity_name, period, chunk_id LIMIT 200 OFFSET 20", whole=True)
def browsed_index_facts(t: Tables) -> DataFrame:
    rows = filter_index_facts(t.index_facts, metric="Coal", measure="actual").select("chunk_id", "entity_name", "period", "value")
    return D.page_of(rows, ["entity_name", "period", "chunk_id"], 200, 20)


CHUNKS = "(SELECT document_id, 1 AS chunk_index, 'text' AS content_type, text AS content FROM {v_report_page} p UNION ALL SELECT document_id, CASE WHEN form = 2 THEN 2 ELSE 3 END, CASE WHEN form = 2 THEN 'structured_fact' ELSE 'table' END, 'TARGET ' || q FROM {v_report_page} p)"


def _chunks(t: Tables) -> DataFrame:
    table = F.col("form") == 2
    more = t.report_page.select("document_id", F.when(table, 2).otherwise(3).alias("chunk_index"), F.when(table, "structured_fact").otherwise("table").alias("content_type"), F.concat(F.lit("TARGET "), F.col("q").cast("string")).alias("content"))
    return t.report_page.select("document_id", F.lit(1).alias("chunk_index"), F.lit("text").alias("content_type"), F.col("text").alias("content")).unionByName(more)


@query(f"SELECT *, (SELECT count(*) FROM {CHUNKS} c WHERE content_type <> 'structured_fact' AND content ILIKE '%target%') AS total FROM {CHUNKS} c WHERE content_type <> 'structured_fact' AND content ILIKE '%target%' ORDER BY document_id, chunk_index LIMIT 100 OFFSET 100")
def browsed_chunks(t: Tables) -> DataFrame:
    """Texts and tables, as structured facts are shown only where they are asked for."""
    return D.page_of(D.browse_chunks(_chunks(t), "Target"), ["document_id", "chunk_index"], 100, 100)


@query(f"SELECT *, (SELECT count(*) FROM {CHUNKS} c WHERE content_type = 'structured_fact') AS total FROM {CHUNKS} c WHERE content_type = 'structured_fact' ORDER BY document_id, chunk_index LIMIT 100")
def browsed_structured_chunks(t: Tables) -> DataFrame:
    return D.page_of(D.browse_chunks(_chunks(t), None, "structured_fact"), ["document_id", "chunk_index"], 100)


#: Pages that name the district (one by its label already), the country, or neither.
PLACED = "CASE form WHEN 0 THEN 'DISTRICT : KOREA, CHHATTISGARH. ' WHEN 1 THEN 'District - Korea. ' WHEN 2 THEN 'District Korea, Republic of. ' WHEN 3 THEN 'Korea District, Chhattisgarh, India. District: Korea. ' ELSE '' END || text"


@query(f"SELECT document_id, CASE WHEN form IN (0, 1) THEN '[Korea District, Chhattisgarh, India]' || chr(10) ELSE '' END || text AS shown, CASE WHEN form IN (0, 1, 3) THEN 'Korea District, Chhattisgarh, India' END AS label, CASE form % 3 WHEN 0 THEN 'Depth of the Seams in BH ' || q WHEN 1 THEN 'The BCCL Report ' || q ELSE 'Borehole Records ' || q END AS title FROM (SELECT document_id, form, q, {PLACED} AS text FROM {{v_report_page}} p) x")
def district_notes(t: Tables) -> DataFrame:
    form, text = F.col("form"), F.expr(PLACED)
    name = F.concat(F.when(form % 3 == 0, "depth_of the  SEAMS_in BH_").when(form % 3 == 1, "the BCCL report_").otherwise("boreHOLE records "), F.col("q").cast("string"))
    return t.report_page.select("document_id", G.annotated(text).alias("shown"), G.location_label(text).alias("label"), N.title_words(name).alias("title"))
