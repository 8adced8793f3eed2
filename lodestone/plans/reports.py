"""More registered queries: extraction from report pages, retrieval, trends over index facts, geological analytics and reviews. The SQL is written on its
own, from the rules, and reads the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.functions.cues import DOMAIN_CUES, TOPIC_CUES
from lodestone.operators import analytics as A
from lodestone.operators import corpus as C
from lodestone.operators import extract as T
from lodestone.operators import facts as X
from lodestone.operators import geology as E
from lodestone.operators import layout as Y
from lodestone.operators import retrieve as R
from lodestone.operators import review as W
from lodestone.operators import strata as S
from lodestone.operators import validate as V
from lodestone.plans.catalog import Tables, query

# Extraction -----------------------------------------------------------------------------------------------------

_PRODUCED = r"(?i)([\w\s\-/]+?)\s+produced\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b(?:[^\n.]{0,80}?during\s+(FY\s?\d\d\d\d|\d\d\d\d-\d\d|\d\d\d\d/\d\d))?"
_ROW = "string_split(line, '|')"
DRAFTS = rf"""pages AS MATERIALIZED (SELECT *, regexp_extract(text, '{_PRODUCED}', 0) AS said FROM {{v_report_page}} p),
told AS (SELECT *, said <> '' AS is_told, CASE WHEN said <> '' THEN trim(regexp_extract(text, '{_PRODUCED}', 1)) END AS mine, nullif(replace(regexp_extract(text, '{_PRODUCED}', 4), ' ', ''), '') AS fy FROM pages),
lines AS (SELECT document_id, is_ocr, unnest(string_split(text, chr(10))) AS line FROM pages WHERE contains(text, '|') AND (contains(text, 'Mine') OR contains(text, 'Production'))),
cells AS (SELECT document_id, is_ocr, line, trim({_ROW}[1]) AS a, trim({_ROW}[2]) AS b, trim({_ROW}[3]) AS c FROM lines WHERE len({_ROW}) >= 3 AND regexp_matches(trim({_ROW}[1]), '(?i)^Mine\s+\w+')),
drafts AS MATERIALIZED (
 SELECT document_id, is_ocr, text, 'production' AS field, regexp_extract(text, '{_PRODUCED}', 2) AS value, regexp_extract(text, '{_PRODUCED}', 3) AS unit, mine AS entity, fy AS year, trim(said, chr(10) || ' ') AS evidence, is_ocr AS ambiguous FROM told WHERE is_told
 UNION ALL SELECT document_id, is_ocr, text, 'production_target', regexp_extract(text, '(?i)target\s+of\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b', 1), regexp_extract(text, '(?i)target\s+of\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b', 2), mine, fy, regexp_extract(text, '(?i)(?:against\s+a\s+)?target\s+of\s+(\d+(?:\.\d+)?)\s*(MT|tonnes|tons|kt)\b', 0), is_ocr FROM told WHERE regexp_matches(text, '(?i)target\s+of\s+\d+(?:\.\d+)?\s*(MT|tonnes|tons|kt)\b')
 UNION ALL SELECT document_id, is_ocr, text, 'achievement_percentage', regexp_extract(text, '(?i)(achievement|achieved)\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*%', 3), '%', mine, fy, regexp_extract(text, '(?i)(achievement|achieved)\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*%', 0), is_ocr FROM told WHERE regexp_matches(text, '(?i)(achievement|achieved)\s*(of|=|:)?\s*\d+(?:\.\d+)?\s*%')
 UNION ALL SELECT document_id, is_ocr, text, 'production', regexp_extract(text, '(?i)Pr[o0]ducti[o0]n\s*[:=]\s*(\d+(?:\.\d+)?)\s*M\??', 1), 'MT', NULL, NULL, regexp_extract(text, '(?i)Pr[o0]ducti[o0]n\s*[:=]\s*(\d+(?:\.\d+)?)\s*M\??', 0), true FROM told WHERE NOT is_told AND regexp_matches(text, '(?i)Pr[o0]ducti[o0]n\s*[:=]\s*\d+(?:\.\d+)?\s*M')
 UNION ALL SELECT document_id, is_ocr, text, 'grade', regexp_extract(text, '(?i)grade\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*%', 2), '%', NULL, NULL, regexp_extract(text, '(?i)(ore grade|grade)\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*%', 0), is_ocr FROM told WHERE regexp_matches(text, '(?i)grade\s*(of|=|:)?\s*\d+(?:\.\d+)?\s*%')
 UNION ALL SELECT document_id, is_ocr, text, 'reserves', regexp_extract(text, '(?i)reserves?\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*(MT|tonnes)', 2), regexp_extract(text, '(?i)reserves?\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*(MT|tonnes)', 3), NULL, NULL, regexp_extract(text, '(?i)reserves?\s*(of|=|:)?\s*(\d+(?:\.\d+)?)\s*(MT|tonnes)', 0), is_ocr FROM told WHERE regexp_matches(text, '(?i)reserves?\s*(of|=|:)?\s*\d+(?:\.\d+)?\s*(MT|tonnes)')
 UNION ALL SELECT c.document_id, c.is_ocr, p.text, 'production', b, 'MT', a, NULL, trim(line), false FROM cells c JOIN pages p USING (document_id) WHERE regexp_full_match(b, '\d+(\.\d+)?')
 UNION ALL SELECT c.document_id, c.is_ocr, p.text, 'production_target', c, 'MT', a, NULL, trim(line), false FROM cells c JOIN pages p USING (document_id) WHERE regexp_full_match(c.c, '\d+(\.\d+)?'))"""
DRAFTS = DRAFTS.replace("'production_target', c, 'MT', a", "'production_target', c.c, 'MT', a")


@query("WITH " + DRAFTS + " SELECT document_id, field, CAST(value AS DOUBLE) AS value, unit, entity, year, evidence, ambiguous FROM drafts")
def report_facts(t: Tables) -> DataFrame:
    return T.production_drafts(t.report_page).select("document_id", "field", N.plain_number(F.col("value")).alias("value"), "unit", "entity", "year", "evidence", "ambiguous")


#: Recognition quality of a page: the mean falls with the page's quantity; some pages' own numbers were read with little confidence.
_MEAN, _LOW = "CAST(90 - q % 40 AS DOUBLE)", "q % 5 = 0"


@query("WITH " + DRAFTS + f""", known AS (SELECT d.*, p.m, p.low, regexp_matches(evidence, '(?i)[0O]{{2,}}|[Il1]{{3,}}|\\?|Pr0duct|M\\?|rn|vv') AS odd, evidence LIKE '%?%' AS asks FROM drafts d JOIN (SELECT document_id, {_MEAN} AS m, CASE WHEN {_LOW} THEN CAST(q AS VARCHAR) || '.9' ELSE '77777' END AS low FROM pages) p USING (document_id)),
summed AS (SELECT *, 0.55 + 0.12 + CASE WHEN length(evidence) >= 8 THEN 0.12 ELSE 0 END + 0.10 + 0.05 + CASE WHEN entity IS NULL THEN 0 ELSE 0.04 END + CASE WHEN year IS NULL THEN 0 ELSE 0.03 END + 0.06 - CASE WHEN ambiguous THEN 0.22 ELSE 0 END + 0.04
 - CASE WHEN is_ocr THEN 0.10 + CASE WHEN odd THEN 0.12 ELSE 0 END + CASE WHEN asks THEN 0.08 ELSE 0 END + CASE WHEN m < 75 THEN 0.12 ELSE 0 END + CASE WHEN m < 60 THEN 0.10 ELSE 0 END + CASE WHEN contains(value, low) OR contains(low, value) THEN 0.18 ELSE 0 END + CASE WHEN m < 80 THEN 0.05 ELSE 0 END ELSE 0 END AS s FROM known)
SELECT document_id, field, evidence, CAST(greatest(0, least(1, round(s, 3))) AS DOUBLE) AS confidence, CASE WHEN round(s, 3) >= 0.85 THEN 'high_confidence' ELSE 'review_required' END AS status FROM summed""")
def report_fact_scores(t: Tables) -> DataFrame:
    pages = t.report_page
    words = pages.select("document_id", "page_number", F.expr(_MEAN).alias("mean_confidence"), F.array(F.when(F.expr(_LOW), F.concat(F.col("q").cast("string"), F.lit(".9"))).otherwise("77777")).alias("low_decimals"))
    return T.scored_drafts(T.production_drafts(pages), words).select("document_id", "field", "evidence", "confidence", "status")


def _count(w: str) -> str:
    text = "regexp_replace(lower(text), '\\s+', ' ', 'g')"
    if " " in w:
        return f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}"
    return f"len(list_filter(regexp_extract_all({text}, '[a-z0-9]+'), lambda x: x = '{w}'))"


_DOMAINS = {d: "round(" + " + ".join(f"least({_count(w)}, 8) * CAST({x} AS DOUBLE)" for w, x in cues.items()) + " + " + " + ".join(f"CASE WHEN contains(lower(filename), '{w}') THEN CAST({0.35 * x} AS DOUBLE) ELSE 0 END" for w, x in list(cues.items())[:6]) + ", 6)" for d, cues in DOMAIN_CUES.items()}


@query("SELECT document_id, CASE WHEN fine THEN name ELSE 'other' END AS domain, top AS score, CASE WHEN fine THEN round(least(0.97, 0.45 + 0.35 * top / greatest(total, 1e-6) + 0.25 * (top - second) / greatest(top, 1e-6)), 3) WHEN top > 0 THEN 0.35 ELSE 0.2 END AS confidence FROM (SELECT document_id, x[1][2] AS name, -x[1][1] AS top, -x[2][1] AS second, total, -x[1][1] >= 2.5 AND total >= 3.0 AS fine FROM (SELECT document_id, list_sort([" + ", ".join(f"(-{d}, '{d}')" for d in DOMAIN_CUES) + "]) AS x, " + " + ".join(DOMAIN_CUES) + " AS total FROM (SELECT document_id, " + ", ".join(f"{sql} AS {d}" for d, sql in _DOMAINS.items()) + " FROM {v_report_page} p)))")
def report_domains(t: Tables) -> DataFrame:
    return C.classify(t.report_page, DOMAIN_CUES, 2.5, 3.0, "filename").select("document_id", "domain", "score", "confidence")


_TOPIC = " UNION ALL ".join(f"SELECT document_id, '{topic}' AS topic, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + " AS n, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {len(w)} ELSE 0 END" for w in words) + " AS len FROM {v_report_page} p" for topic, words in TOPIC_CUES.items())


@query(f"SELECT topic, count(DISTINCT document_id) AS documents, count(*) AS chunks, CAST((2 * sum(m) + 1000 * count(*)) // (2000 * count(*)) AS DOUBLE) / 1000 AS confidence FROM (SELECT topic, document_id, score, CAST(round(score * 1000000) AS BIGINT) AS m FROM (SELECT topic, document_id, round(least(1.0, 0.35 + 0.15 * n + 0.05 * len / 40), 6) AS score FROM ({_TOPIC}) WHERE n > 0)) WHERE score >= 0.4 GROUP BY topic")
def report_topics(t: Tables) -> DataFrame:
    return C.topic_counts(C.topics(t.report_page.select("document_id", F.col("document_id").alias("chunk_id"), F.col("text").alias("content")), TOPIC_CUES))


@query("""WITH k AS (SELECT l_orderkey AS d, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS whole, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT CAST(d AS VARCHAR) AS document_id, string_agg(whole || '.' || CASE WHEN k <> 3 THEN CAST(40 + k AS VARCHAR) ELSE '38' END, ' ' ORDER BY k) AS text FROM k GROUP BY d""")
def number_replacements(t: Tables) -> DataFrame:
    """Two passes of recognition over the pages of orders: the second reads the third number's decimals as 38, where the first has 33."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("int").cast("string").alias("whole"), k.alias("k"))
    text = lambda third: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("whole", F.lit("."), F.when(F.col("k") == 3, third).otherwise((F.col("k") + 40).cast("string"))).alias("n")))), lambda x: x["n"]), " ")
    pages = lines.groupBy(F.col("l_orderkey").cast("string").alias("document_id"), F.lit(1).alias("page_number")).agg(text("33").alias("text"), text("38").alias("detail"))
    base = pages.select("document_id", "page_number", "text")
    return Y.apply_replacements(base, Y.reconciled(base, pages.select("document_id", "page_number", F.col("detail").alias("text")))).select("document_id", "text")


@query("""SELECT document_id, metric_kind, seam_name, borehole_id, depth, thickness, original_value, metres FROM (SELECT document_id, unnest([
 {'metric_kind': 'seam_thickness', 'seam_name': 'Seam ' || seam, 'borehole_id': borehole, 'depth': n || '.5', 'thickness': n || '.25', 'original_value': NULL, 'metres': CAST(n || '.25' AS DOUBLE)},
 {'metric_kind': NULL, 'seam_name': 'Seam ' || seam, 'borehole_id': NULL, 'depth': NULL, 'thickness': NULL, 'original_value': NULL, 'metres': NULL}, {'metric_kind': NULL, 'seam_name': 'Seam ' || seam, 'borehole_id': NULL, 'depth': NULL, 'thickness': NULL, 'original_value': NULL, 'metres': NULL},
 {'metric_kind': 'minimum_workable_seam_thickness', 'seam_name': NULL, 'borehole_id': NULL, 'depth': NULL, 'thickness': '0.90', 'original_value': NULL, 'metres': CAST('0.90' AS DOUBLE)}, {'metric_kind': 'resource_quantity', 'seam_name': 'Seam ' || seam, 'borehole_id': NULL, 'depth': NULL, 'thickness': NULL, 'original_value': n || '.75', 'metres': NULL},
 {'metric_kind': 'formation', 'seam_name': NULL, 'borehole_id': NULL, 'depth': NULL, 'thickness': NULL, 'original_value': NULL, 'metres': NULL}], recursive := true) FROM {v_core_page} p)""")
def strata_facts(t: Tables) -> DataFrame:
    """Six facts a page: a borehole's depth and thickness with its seam, the seam twice, the workable thickness, a resource, a formation."""
    rows = S.scored(S.drafts(t.core_page))
    return rows.select("document_id", "metric_kind", "seam_name", "borehole_id", "depth", "thickness", "original_value", F.col("thickness_normalized_m").alias("metres"))


# Retrieval ------------------------------------------------------------------------------------------------------

ASKED = "(VALUES (1, 'How much coal did Block produce in FY2024?'), (2, 'What was the production of SCCL in 2023-24'), (3, 'Which grade was met?'))"


def _questions(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM {ASKED} AS a(query_id, query)")


#: Terms of each question, the names among them, whether production is asked for, and the organisation, by hand from the rules.
TERMS = "(VALUES (1, ['coal', 'block', 'produce', 'fy2024'], ['block'], true, ''), (2, ['production', 'sccl', '2023-24', '2023-2024', 'produced'], ['sccl', '2023-24', '2023-2024'], true, 'sccl'), (3, ['grade', 'met'], ['grade', 'met'], false, ''))"
BOOSTED = f"""boosted AS MATERIALIZED (SELECT query_id, document_id, text, CASE WHEN hits = 0 AND NOT any_name THEN -0.05 ELSE greatest(-0.55, least(0.75, 0.35 * hits / len(terms) + CASE WHEN query_id = 2 AND contains(hay, 'sccl') THEN 0.12 ELSE 0 END + CASE WHEN has THEN 0.28 ELSE -0.45 END
  + CASE WHEN org <> '' AND contains(hay, 'nlc india') THEN -0.22 ELSE 0 END)) END AS boost
 FROM (SELECT query_id, terms, org, asks, document_id, text, hay, len(list_filter(terms, lambda x: contains(hay, x))) AS hits, len(list_filter(named, lambda x: contains(hay, x))) > 0 AS has, contains(hay, 'lignite') OR contains(hay, 'sccl') AS any_name
  FROM (SELECT query_id, terms, named, asks, org, document_id, text, lower(text) AS hay FROM {TERMS} q(query_id, terms, named, asks, org), {{v_report_page}} p)))"""


@query("WITH " + BOOSTED + " SELECT query_id, document_id, round(CAST(boost AS DOUBLE), 6) AS boost FROM boosted")
def keyword_boosts(t: Tables) -> DataFrame:
    asked = _questions(t).withColumn("terms", R.query_terms(F.col("query")))
    rows = t.report_page.select("document_id", "text").crossJoin(F.broadcast(asked))  # three questions
    return rows.select("query_id", "document_id", F.round(R.keyword_boost(F.col("query"), F.col("text"), F.col("terms")), 6).alias("boost"))


@query("WITH " + BOOSTED + """, near AS (SELECT b.*, CAST(form AS DOUBLE) / 10 AS score FROM boosted b JOIN (SELECT document_id, form FROM {v_report_page} p) USING (document_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) <= 100)
SELECT query_id, document_id, round(greatest(0, least(1, score + boost)), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0, least(1, score + boost)), 6) DESC, document_id) AS INT) AS rank FROM near WHERE round(greatest(0, least(1, score + boost)), 6) >= 0.28 QUALIFY rank <= 10""")
def hybrid_hits(t: Tables) -> DataFrame:
    rows = t.report_page.crossJoin(F.broadcast(_questions(t)))  # three questions
    hits = rows.select("query_id", "query", F.col("document_id").alias("id"), F.col("text").alias("content"), (F.col("form") / 10).alias("score"))
    return R.hybrid(hits).select("query_id", F.col("id").alias("document_id"), "score", "rank")


#: Reconstructed tables of each document's facts, next to plain texts and structured facts of the same pages.
_TITLE = "Table 3 reconstructed from source: "


@query(f""", line AS (SELECT document_id, period, 'Mine ' || substr(entity_name, 6) || ' coal | reporting_period=March | measure=' || CASE field WHEN 'production' THEN 'during' ELSE 'target' END || ' | FY25=' || page_number || '.5 MT | FY24=2.5 MT.' AS row, entity, field, page_number, id FROM fx WHERE field IN ('production', 'production_target')),
hit AS (SELECT 1 AS spec_id, id, document_id, page_number AS page, '{_TITLE}Other Mine coal | reporting_period=March | measure=during | FY25=1.5 MT | FY24=2.5 MT. ' || row AS content, entity = 'mine 12' AND field = 'production' AS cut FROM line),
ranked AS (SELECT spec_id, id, document_id, page, CASE WHEN cut THEN '{_TITLE}' || split_part(content, 'FY24=2.5 MT. ', 2) ELSE content END AS content, round(0.5 + CASE WHEN cut THEN 0.08 ELSE 0.05 END, 6) AS score, round(1.0 + CASE WHEN cut THEN 0.15 ELSE 0.10 END, 6) AS compat FROM hit)
SELECT spec_id, id, document_id, page, content, 'text' AS content_type, CAST(score AS DOUBLE) AS score, CAST(compat AS DOUBLE) AS compat, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY round(score + compat, 6) DESC, id) AS INT) AS rank FROM ranked QUALIFY rank <= 8
UNION ALL SELECT * FROM (SELECT 2, 'fact/' || id, document_id, page_number, row, 'structured_fact', CAST(0.6 AS DOUBLE), CAST(1.2 AS DOUBLE), CAST(row_number() OVER (ORDER BY 'fact/' || id) AS INT) AS rank FROM line QUALIFY rank <= 8)""")
def table_evidence(t: Tables) -> DataFrame:
    rows = X.normalized(t.fact).where("field in ('production', 'production_target')")
    measure = F.when(F.col("field") == "production", "during").otherwise("target")
    row = F.concat(F.lit("Mine "), F.substring("entity_name", 6, 9), F.lit(" coal | reporting_period=March | measure="), measure, F.lit(" | FY25="), F.col("page_number").cast("string"), F.lit(".5 MT | FY24=2.5 MT."))
    hit = lambda spec, id_, text, kind, score, compat: rows.select(F.lit(spec).alias("spec_id"), id_.alias("id"), "document_id", F.col("page_number").alias("page"), text.alias("content"), F.lit(kind).alias("content_type"), F.lit(score).alias("score"), F.lit(compat).alias("compat"))
    table = F.concat(F.lit(_TITLE), F.lit("Other Mine coal | reporting_period=March | measure=during | FY25=1.5 MT | FY24=2.5 MT. "), row)
    own, raw = F.col("id"), F.concat(F.lit("raw/"), F.col("id"))
    hits = hit(1, own, table, "text", 0.5, 1.0).unionByName(hit(1, raw, row, "text", 0.9, 1.0)).unionByName(hit(2, F.concat(F.lit("fact/"), own), row, "structured_fact", 0.6, 1.2)).unionByName(hit(2, raw, row, "text", 0.9, 1.2)).unionByName(hit(1, own, table, "text", 0.1, 1.0))
    specs = t.spark.sql("SELECT * FROM VALUES (1, 'Mine 12', array(), array('during'), false), (2, 'Mine 12', array(), array(), true) AS s(spec_id, entity, months, measures, prefers_numeric)").withColumn("months", F.col("months").cast("array<string>")).withColumn("measures", F.col("measures").cast("array<string>"))
    return R.preferred_evidence(hits, specs, 8)


@query("""SELECT document_id, metric, CAST(CASE metric WHEN 'seam' THEN CASE WHEN form = 3 THEN 0.55 ELSE 0 END WHEN 'borehole' THEN CASE WHEN form = 3 THEN 0.3 ELSE 0 END WHEN 'lithology' THEN CASE WHEN form IN (0, 3) THEN 0.15 ELSE 0 END ELSE CASE WHEN form = 3 THEN 0.35 ELSE 0 END END AS DOUBLE) AS bonus
FROM {v_report_page} p, (VALUES ('seam'), ('borehole'), ('lithology'), ('formation')) m(metric)""")
def geological_bonuses(t: Tables) -> DataFrame:
    metrics = F.explode(F.array(*map(F.lit, ("seam", "borehole", "lithology", "formation"))))
    return t.report_page.select("document_id", "text", metrics.alias("metric")).select("document_id", "metric", R.geological_bonus(F.col("text"), F.col("metric")).alias("bonus"))


@query("""SELECT id AS fact_id, bucket = 'verified' AS verified FROM gx WHERE bucket <> 'rejected' AND kind = 'borehole_depth'""")
def verified_and_unverified(t: Tables) -> DataFrame:
    depths = t.typed.where("bucket <> 'rejected' and kind = 'borehole_depth'").select(F.col("id").alias("fact_id"), "bucket")
    return R.verified_and_others(depths.where("bucket = 'verified'"), depths).select("fact_id", "verified")


# Trends over index facts ----------------------------------------------------------------------------------------


@query("""SELECT lower(entity_name) AS entity, storage_metric, period, measure, value, unit, fact_id, source, document_id FROM (
 SELECT *, max(source = 'index') OVER w AS indexed, max(coalesce(measure = 'during', false)) OVER w AS has_during FROM (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY lower(entity_name), storage_metric, period, round(value, 6), coalesce(measure, '') ORDER BY CASE source WHEN 'index' THEN 0 ELSE 1 END, fact_id) = 1) WINDOW w AS (PARTITION BY lower(entity_name), storage_metric)) m
ANTI JOIN openc o ON lower(m.entity_name) = o.entity AND m.storage_metric = o.field AND m.period = o.period
WHERE NOT indexed OR NOT has_during OR measure = 'during' QUALIFY row_number() OVER (PARTITION BY lower(entity_name), storage_metric, m.period ORDER BY confidence DESC, fact_id DESC) = 1""", whole=True)
def merged_trend(t: Tables) -> DataFrame:
    return A.merged_trend(t.classified, t.conflict)


@query(""", pair AS (SELECT lower(entity_name) AS entity, storage_metric, period, arg_max(value, (confidence, fact_id)) FILTER (measure = 'during') AS actual, arg_max(value, (confidence, fact_id)) FILTER (measure = 'target') AS target, arg_max(fact_id, (confidence, fact_id)) FILTER (measure = 'during') AS actual_id, arg_max(fact_id, (confidence, fact_id)) FILTER (measure = 'target') AS target_id
 FROM cx WHERE source = 'index' AND measure IN ('during', 'target') AND storage_metric IN ('production', 'coal', 'lignite') GROUP BY ALL),
first_pair AS (SELECT *, 'index' AS path FROM pair WHERE actual IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY CASE storage_metric WHEN 'production' THEN 0 WHEN 'coal' THEN 1 ELSE 2 END) = 1),
named AS (SELECT a.entity, a.period, a.numeric_value AS actual, b.numeric_value AS target, a.id AS actual_id, b.id AS target_id, 'fields' AS path FROM px a JOIN px b ON a.entity = b.entity AND a.period = b.period WHERE a.field = 'production' AND b.field = 'production_target'),
both_paths AS (SELECT entity, period, actual, target, actual_id, target_id, path FROM first_pair UNION ALL SELECT n.* FROM named n ANTI JOIN first_pair f ON n.entity = f.entity AND n.period = f.period)
SELECT *, round(actual / nullif(target, 0) * 100, 2) AS achievement FROM both_paths""", whole=True)
def merged_actual_vs_target(t: Tables) -> DataFrame:
    return A.actual_vs_target_merged(t.classified, t.usable)


# Geological analytics -------------------------------------------------------------------------------------------

_LABEL = "CASE kind WHEN 'resource_quantity' THEN 'Seam Resource' WHEN 'minimum_workable_seam_thickness' THEN 'Minimum Workable Seam Thickness' WHEN 'seam_thickness' THEN 'Seam Thickness' WHEN 'borehole_depth' THEN 'Borehole Depth' ELSE 'Formation' END"


@query(f"""SELECT id AS fact_id, g.document_id, coalesce(d.filename, g.document_id) AS entity, kind AS metric, {_LABEL} AS metric_label, CASE kind WHEN 'formation' THEN formation END AS listed, CASE WHEN kind <> 'formation' THEN coalesce(metres, CAST(value_num AS DOUBLE)) END AS number, CASE WHEN kind <> 'formation' THEN coalesce(seam, formation, borehole_key) END AS point, 'p.' || source_page AS period, seam, formation, borehole_key AS borehole, source_page AS page, g.status, bucket
FROM gx g LEFT JOIN {{v_document}} d ON g.document_id = d.document_id WHERE bucket <> 'rejected'""")
def geological_analytics(t: Tables) -> DataFrame:
    return E.analytics_rows(t.typed, t.document).withColumn("listed", F.when(F.col("metric") == "formation", F.col("formation"))).drop("value")


@query("""SELECT 'facts' AS part, count(*) AS n FROM gx WHERE bucket <> 'rejected' UNION ALL SELECT 'filters', count(*) FROM (SELECT DISTINCT axis, value FROM (SELECT unnest(['document_id', 'formation', 'seam', 'borehole_key', 'kind']) AS axis, unnest([document_id, formation, seam, borehole_key, kind]) AS value FROM gx WHERE bucket <> 'rejected') WHERE value IS NOT NULL)
UNION ALL SELECT 'summary', count(DISTINCT document_id) + 1 FROM gx WHERE bucket <> 'rejected' UNION ALL SELECT 'formations', count(DISTINCT formation) FROM gx WHERE bucket <> 'rejected' UNION ALL SELECT 'seams', count(DISTINCT (document_id, seam)) FROM gx WHERE bucket <> 'rejected' AND seam IS NOT NULL
UNION ALL SELECT 'boreholes', count(DISTINCT (document_id, borehole_key)) FROM gx WHERE bucket <> 'rejected' UNION ALL SELECT 'tree', count(DISTINCT formation) FROM gx WHERE bucket <> 'rejected' AND seam IS NOT NULL
UNION ALL SELECT 'resources', count(DISTINCT (document_id, seam)) FROM gx WHERE kind = 'resource_quantity' AND seam IS NOT NULL AND bucket = 'verified' UNION ALL SELECT 'depths', count(DISTINCT (document_id, borehole_key)) FROM gx WHERE kind = 'borehole_depth' AND bucket = 'verified'
UNION ALL SELECT 'thickness', count(DISTINCT (document_id, seam)) FROM gx WHERE kind = 'seam_thickness' AND seam IS NOT NULL AND bucket = 'verified'""")
def explorer_counts(t: Tables) -> DataFrame:
    return E.overview_counts(E.explorer_overview(t.typed, t.document))


_WANTED = ("seam_thickness", "seam", "resource", "borehole_depth", "minimum_workable_seam_thickness", "formation")


@query("""SELECT id, wanted, CASE wanted WHEN 'seam_thickness' THEN kind = 'seam_thickness' WHEN 'seam' THEN kind IN ('seam_thickness', 'resource_quantity') WHEN 'resource' THEN kind = 'resource_quantity' ELSE kind = wanted END AS fits
FROM gx, (VALUES ('seam_thickness'), ('seam'), ('resource'), ('borehole_depth'), ('minimum_workable_seam_thickness'), ('formation')) w(wanted)""")
def metric_compatibility(t: Tables) -> DataFrame:
    rows = t.typed.select("id", "kind", F.explode(F.array(*map(F.lit, _WANTED))).alias("wanted"))
    return rows.select("id", "wanted", G.metrics_compatible(F.col("wanted"), F.col("kind")).alias("fits"))


@query("""SELECT g.id, CASE WHEN status = 'rejected' OR a.action IS NULL THEN status WHEN a.action = 'approve' THEN 'approved' WHEN a.action = 'reject' THEN 'rejected' ELSE 'corrected' END AS status, CASE WHEN corrected THEN CAST(n AS VARCHAR) ELSE CAST(CAST(value_num AS INT) AS VARCHAR) END AS value, length_unit AS unit,
 CASE WHEN NOT corrected THEN metres WHEN kind LIKE '%thickness%' OR kind LIKE '%depth%' THEN n * CAST(CASE length_unit WHEN 'm' THEN 1.0 WHEN 'cm' THEN 0.01 ELSE 0.3048 END AS DOUBLE) END AS metres, CASE WHEN corrected THEN CAST(CAST(value_num AS INT) AS VARCHAR) END AS original_value
FROM (SELECT g.*, a.action, a.n, coalesce(a.action = 'correct' AND status <> 'rejected', false) AS corrected FROM gx g LEFT JOIN (SELECT user_id % 60 AS b, action, CAST(seq % 90 AS INT) AS n FROM (SELECT event_id AS seq, ts, user_id, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'correct' END AS action FROM events) QUALIFY row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts, seq) = 1) a ON g.borehole_id = 'BH-' || a.b) g, (SELECT 1) one, LATERAL (SELECT g.action) a(action)""")
def reviewed_geological_facts(t: Tables) -> DataFrame:
    rows = t.typed.select("id", "status", "kind", F.col("value_num").cast("int").cast("string").alias("value"), F.col("length_unit").alias("unit"), "metres", "borehole_id")
    verb = F.when(F.col("event_id") % 3 == 0, "approve").when(F.col("event_id") % 3 == 1, "reject").otherwise("correct")
    events = t.events.select(F.concat(F.lit("BH-"), (F.col("user_id") % 60).cast("string")).alias("borehole_id"), F.col("ts").alias("acted_at"), F.col("event_id").alias("seq"), verb.alias("action"), (F.col("event_id") % 90).cast("int").cast("string").alias("corrected_value"), F.lit(None).cast("string").alias("corrected_unit"))
    first = X.one_per(events, ["borehole_id"], ["acted_at", "seq"])  # the first action on a borehole, for each of its rows
    return W.apply_geological_actions(rows, rows.select(F.col("id").alias("fact_id"), "borehole_id").join(first, "borehole_id"))


# Reviews --------------------------------------------------------------------------------------------------------


@query(""", wide AS (SELECT document_id, entity, period, round(max(numeric_value) FILTER (field = 'production') / max(numeric_value) FILTER (field = 'production_target') * 100, 2) AS calculated FROM fx WHERE status <> 'rejected' GROUP BY ALL)
SELECT f.id, CASE WHEN f.field = 'dispatch' AND f.status = 'high_confidence' AND abs(w.calculated - f.numeric_value) > 2.0 THEN 'review_required' ELSE f.status END AS status, CASE WHEN f.field = 'dispatch' AND r.told > 0 AND abs(w.calculated - r.told) > 2.0 THEN 'achievement_discrepancy' END AS warning
FROM fx f LEFT JOIN wide w ON f.document_id = w.document_id AND f.entity = w.entity AND f.period = w.period LEFT JOIN (SELECT document_id, entity, period, arg_max(numeric_value, id) AS told FROM fx WHERE field = 'dispatch' AND status <> 'rejected' GROUP BY ALL) r ON f.document_id = r.document_id AND f.entity = r.entity AND f.period = r.period""")
def downgraded_achievements(t: Tables) -> DataFrame:
    """The dispatched quantities stand for reported achievements."""
    told = t.fact.withColumn("field_name", F.when(F.col("field_name") == "dispatch", "achievement").otherwise(F.col("field_name")))
    return V.downgraded_achievements(told).select("id", "status", "warning")


@query("""SELECT event_id AS id, '{"type":"' || event_type || '","auth":{"user":' || user_id || ',"more":{"n":' || event_id % 7 || '}}}' AS details FROM events""")
def audit_details(t: Tables) -> DataFrame:
    text = F.format_string('{"type":"%s","Password_Hash":"x","auth":{"user":%d,"TOKEN":"y","more":{"secret":{"a":1},"n":%d}}}', "event_type", "user_id", F.col("event_id") % 7)
    return t.events.select(F.col("event_id").alias("id"), N.sanitize_json(text).alias("details"))
