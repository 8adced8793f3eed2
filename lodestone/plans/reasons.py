"""Queries of comparisons over required slots, evidence packs and document scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import reason as Q
from lodestone.operators import scope as S
from lodestone.plans.catalog import Tables, query


def _specs(t: Tables) -> DataFrame:
    """Changes of a mine over two years, two mines in their latest common year, in a given one by one and by two measures, a change without years, and what compares nothing."""
    text = lambda *xs: F.array(*(F.lit(x) for x in xs))
    form = F.col("form")
    return t.ask.select(
        "spec_id", F.when(form.isin(1, 2, 3), F.array("e1", "e2")).otherwise(F.array("e1")).alias("entities"),
        F.when(form == 2, text("lignite")).when(form == 3, text("production")).otherwise(text("production", "coal")).alias("metrics"), F.when(form == 0, text("March")).alias("months"),
        F.when(form == 0, F.array("first_period", "last_period")).when(form.isin(2, 3, 5), F.array("last_period")).alias("periods"), F.when(form == 3, text("target", "during")).alias("measures"),
        F.when(form.isin(0, 4), "change").when(form == 2, "rank").when(form.isin(1, 3), "compare").alias("mode"))


def _facts(t: Tables) -> DataFrame:
    f = t.index_facts
    return f.select(F.col("chunk_id").alias("fact_id"), "entity_name", "metric", "reporting_month", "period", "measure", "value", "unit", F.lit(None).cast("string").alias("table_title"), "page", F.lit("approved").alias("status"))


SLOTS = """, asked AS (SELECT *, CASE WHEN form IN (0, 4) THEN 'change' WHEN form = 2 THEN 'rank' WHEN form IN (1, 3) THEN 'compare' END AS mode, form = 1 AS aligned, CASE WHEN form IN (1, 2, 3) THEN [e1, e2] ELSE [e1] END AS es,
  CASE WHEN form = 0 AND first_period <> last_period THEN [first_period, last_period] WHEN form IN (0, 2, 3, 5) THEN [last_period] WHEN form = 1 THEN [NULL] ELSE [] END AS ps, CASE WHEN form = 3 THEN ['target', 'during'] ELSE ['during'] END AS ks, CASE form WHEN 2 THEN 'lignite' WHEN 3 THEN 'production' ELSE 'coal' END AS m FROM {v_ask} a),
need AS (SELECT spec_id, mode, aligned, m, CASE form WHEN 0 THEN 'March' END AS mo, len(es) AS ne, e, e_at, p, k, CAST(((e_at - 1) * len(ps) + p_at - 1) * len(ks) + k_at - 1 AS INT) AS slot
  FROM asked, LATERAL (SELECT unnest(es) AS e, generate_subscripts(es, 1) AS e_at) x, LATERAL (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS p_at) y, LATERAL (SELECT unnest(ks) AS k, generate_subscripts(ks, 1) AS k_at) z),
dims AS MATERIALIZED (SELECT entity_name AS entity, metric, reporting_month AS month, period, measure, min(value) AS lo, max(value) AS hi, min((page, chunk_id)) AS ord, arg_min(value, (page, chunk_id)) AS value, arg_min(chunk_id, (page, chunk_id)) AS id FROM ix WHERE value IS NOT NULL GROUP BY ALL),
cand AS MATERIALIZED (SELECT n.*, d.* FROM need n LEFT JOIN dims d ON d.entity = n.e AND d.measure = n.k AND (d.metric = n.m OR (n.m = 'production' AND d.metric IN ('coal', 'lignite'))) AND (n.mo IS NULL OR d.month = n.mo) AND (n.p IS NULL OR d.period = n.p)),
filled AS (SELECT spec_id, mode, aligned, slot, e, m, mo, p, k, coalesce(bool_or(hi - lo > 1e-6), false) AS bad, min(lo) FILTER (hi - lo > 1e-6) AS low, max(hi) FILTER (hi - lo > 1e-6) AS high, arg_min(id, ord) AS id, arg_min(value, ord) AS value, arg_min(period, ord) AS period FROM cand GROUP BY ALL)
"""


@query(f"""{SLOTS} SELECT spec_id, slot, e AS entity, m AS metric, mo AS month, p AS period, k AS measure, CASE WHEN bad THEN 'conflict' WHEN id IS NULL THEN 'missing' ELSE 'value' END AS state, CASE WHEN NOT bad THEN id END AS fact_id, CASE WHEN NOT bad THEN value END AS value, low, high FROM filled""", whole=True)
def required_slots(t: Tables) -> DataFrame:
    return Q.filled_slots(_specs(t), _facts(t)).drop("unit")


@query(f"""{SLOTS}, each AS (SELECT spec_id, ne, period AS year, e_at, arg_min(value, ord) AS value, any_value(e) AS e FROM cand WHERE aligned AND id IS NOT NULL GROUP BY ALL),
shared AS (SELECT spec_id, year, arg_max(e, (value, -e_at)) AS top, arg_min(e, (value, -e_at)) AS bottom, max(value) AS hi, min(value) AS lo FROM each GROUP BY spec_id, ne, year HAVING count(*) = ne QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY year DESC) = 1),
flat AS (SELECT spec_id, aligned, bool_or(bad) AS bad, count(*) FILTER (id IS NULL) AS lost, count(id) AS n, string_agg(concat_ws(' ', e, m, mo, p, k), '; ' ORDER BY slot) FILTER (id IS NULL) AS missing, count(DISTINCT CASE WHEN id IS NOT NULL THEN e END) AS names, arg_min(value, (period, slot)) FILTER (id IS NOT NULL) AS v0, arg_max(value, (period, slot)) FILTER (id IS NOT NULL) AS v1, min(period) AS p0, max(period) AS p1,
  arg_max(e, (value, -slot)) FILTER (id IS NOT NULL) AS top, arg_min(e, (value, -slot)) FILTER (id IS NOT NULL) AS bottom, max(value) AS hi, min(value) AS lo FROM filled GROUP BY ALL),
judged AS (SELECT a.spec_id, a.form, s.year, CASE WHEN f.bad THEN 'conflict' WHEN a.mode IS NULL THEN 'ok' WHEN f.spec_id IS NULL OR (a.aligned AND s.year IS NULL) OR (NOT a.aligned AND f.lost > 0) THEN 'insufficient' ELSE 'ok' END AS status, CASE WHEN a.aligned THEN CASE WHEN s.year IS NULL THEN 0 ELSE 2 END ELSE coalesce(f.n, 0) END AS n_values,
  CASE WHEN NOT a.aligned THEN f.missing END AS missing, f.names, v0, v1, p0, p1, coalesce(s.top, f.top) AS top, coalesce(s.bottom, f.bottom) AS bottom, coalesce(s.hi, f.hi) AS hi, coalesce(s.lo, f.lo) AS lo FROM asked a LEFT JOIN flat f ON a.spec_id = f.spec_id LEFT JOIN shared s ON a.spec_id = s.spec_id)
SELECT spec_id, status, CAST(n_values AS BIGINT) AS n_values, CASE WHEN status = 'insufficient' THEN missing END AS missing, lower(year) AS year,
  CASE WHEN status <> 'ok' THEN NULL WHEN form = 0 AND p0 <> p1 THEN CASE WHEN v1 > v0 THEN p1 WHEN v1 < v0 THEN p0 END WHEN form IN (1, 2, 3) THEN top END AS higher, CASE WHEN status <> 'ok' THEN NULL WHEN form = 0 AND p0 <> p1 THEN CASE WHEN v1 > v0 THEN p0 WHEN v1 < v0 THEN p1 END WHEN form IN (1, 2, 3) THEN bottom END AS lower,
  CASE WHEN status <> 'ok' THEN NULL WHEN form = 0 AND p0 <> p1 THEN v1 - v0 WHEN form IN (1, 2) THEN hi - lo END AS change, CASE WHEN status <> 'ok' THEN NULL WHEN form = 0 AND p0 <> p1 THEN round((v1 - v0) / v0 * 100, 2) WHEN form IN (1, 2) THEN round((hi - lo) / lo * 100, 2) END AS percent FROM judged""", whole=True)
def comparisons(t: Tables) -> DataFrame:
    """Verdicts on all questions: changes, rankings, gaps and conflicts."""
    return Q.reasoned(_specs(t), _facts(t)).select("spec_id", "status", "n_values", F.array_join("missing", "; ").alias("missing"), "year", "higher", "lower", "change", "percent")


@query("""SELECT entity_name, metric, reporting_month, period, measure, unit, count(*) AS n_values, list(value ORDER BY value)[:6] AS evidence, list(id ORDER BY value)[:6] AS facts FROM (SELECT entity_name, metric, reporting_month, period, measure, unit, round(value, 6) AS value, min(chunk_id) AS id FROM ix GROUP BY ALL) GROUP BY ALL HAVING max(value) - min(value) > 1e-6""", whole=True)
def contradictions_with_evidence(t: Tables) -> DataFrame:
    out = Q.disagreements(_facts(t))
    return out.withColumns({"facts": F.col("evidence.fact_id"), "evidence": F.col("evidence.value")})


#: Open conflicts of production by the years of index facts; texts are facts that wait for a review, of the mine that is asked about.
@query(f"""{SLOTS}, hits AS (SELECT DISTINCT spec_id, entity, metric, month, period, measure, hi - lo > 1e-6 AS bad, id FROM cand WHERE id IS NOT NULL),
told AS (SELECT a.spec_id, f.id, f.confidence_score AS score FROM asked a JOIN fx f ON f.entity_name = a.e1 WHERE f.status = 'review_required'),
stored AS (SELECT DISTINCT h.spec_id, c.entity_name || '|' || c.field_name || '|' || c.period AS c FROM hits h JOIN {{v_conflict}} c ON h.entity = c.entity_name AND h.metric = c.field_name AND left(h.period, 6) = c.period WHERE c.status = 'review_required'),
counts AS (SELECT a.spec_id, (SELECT count(*) FROM hits h WHERE h.spec_id = a.spec_id) AS n_structured, (SELECT coalesce(bool_or(bad), false) FROM hits h WHERE h.spec_id = a.spec_id) AS bad, (SELECT count(*) FROM told h WHERE h.spec_id = a.spec_id) AS n_texts, (SELECT count(*) FROM stored h WHERE h.spec_id = a.spec_id) AS n_conflicts,
  (SELECT count(*) FROM filled h WHERE h.spec_id = a.spec_id AND id IS NULL) AS n_missing, (SELECT string_agg(id, ',' ORDER BY n) FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n FROM told h WHERE h.spec_id = a.spec_id) WHERE n <= 10) AS first_texts,
  (SELECT string_agg(id, ',' ORDER BY n) FROM (SELECT id, row_number() OVER (ORDER BY slot, id) AS n FROM (SELECT id, min(slot) AS slot FROM cand h WHERE h.spec_id = a.spec_id AND id IS NOT NULL GROUP BY id)) WHERE n <= 10) AS first_facts FROM asked a)
SELECT spec_id, CASE WHEN n_structured > 0 AND n_texts > 0 THEN 'hybrid' WHEN n_structured > 0 THEN 'structured' WHEN n_texts > 0 THEN 'rag' ELSE 'none' END AS route, n_structured, n_texts, n_conflicts, n_missing, coalesce(first_facts, '') AS first_facts, coalesce(first_texts, '') AS first_texts,
  concat_ws(' ', CASE WHEN bad OR n_conflicts > 0 THEN 'Conflicting evidence: no single value was selected.' END, CASE WHEN n_missing > 0 THEN 'A required value was not found.' END, CASE WHEN n_structured + n_texts = 0 THEN 'No reliable evidence was found.' END) AS warnings FROM counts""", whole=True)
def evidence_packs(t: Tables) -> DataFrame:
    year = F.substring("period", 3, 4).cast("int")
    c = t.conflict.where("status = 'review_required'")
    conflicts = c.select(F.concat_ws("|", "entity_name", "field_name", "period").alias("fingerprint"), "entity_name", F.col("field_name").alias("metric"), F.concat(F.lit("FY"), year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")).alias("period"))
    f = t.fact.where("status = 'review_required'").withColumnRenamed("entity_name", "e1")
    texts = t.ask.select("spec_id", "e1").join(f, "e1").select("spec_id", "id", "document_id", F.col("page_number").alias("page"), F.col("confidence_score").alias("score"))
    ids = lambda c: F.array_join(F.col(c), ",")
    out = Q.packs(_specs(t), _facts(t), texts, conflicts)
    return out.select("spec_id", "route", "n_structured", "n_texts", "n_conflicts", "n_missing", ids("structured.fact_id").alias("first_facts"), ids("texts.id").alias("first_texts"), F.array_join("warnings", " ").alias("warnings"))


def _asks(t: Tables) -> DataFrame:
    """One spec for each document, in seven forms, about its own block or the next one."""
    d, k = F.substring("document_id", 4, 20).cast("long"), F.regexp_extract("filename", r"(\d+)", 1).cast("long")
    form = F.col("d") % 7
    block = lambda n: F.concat(F.lit("Block "), n.cast("string"))
    own, other = block(F.col("k")), block(F.col("k") + 1)
    return t.document.withColumns({"d": d, "k": k}).select(
        F.col("d").alias("spec_id"), F.when(form == 3, other).when(form.isin(4, 5), own).alias("entity"), F.when(form == 0, F.array(own, other)).alias("entities"),
        F.when(form.isin(2, 3), F.col("document_id")).alias("selected_id"), F.when(form == 4, F.col("document_id")).alias("session_id"),
        (form < 5).alias("geological"), (form == 0).alias("cross"), form.isin(1, 2).alias("deictic"), form.isin(3, 4).alias("names_place"))


def _scopes(t: Tables) -> tuple[DataFrame, DataFrame]:
    return S.scopes(_asks(t), t.document.withColumn("created_at", F.col("weight")))


SCOPES = """docs AS (SELECT document_id, CAST(substr(document_id, 4) AS BIGINT) AS d, CAST(regexp_extract(filename, '([0-9]+)', 1) AS BIGINT) AS k, version, weight FROM {v_document} v),
fam AS (SELECT k, arg_max(document_id, (version, weight, document_id)) AS head, list(document_id) AS ids FROM docs GROUP BY k),
scoped AS (SELECT a.d AS spec_id, CASE a.d % 7 WHEN 0 THEN 'cross_document_comparison' WHEN 1 THEN 'deictic_missing_current_document' WHEN 2 THEN 'current_document_deictic' WHEN 3 THEN CASE WHEN y.k IS NULL THEN 'current_document_geological_default' ELSE 'entity_other_document' END
    WHEN 4 THEN 'current_document_geological_default' WHEN 5 THEN 'entity_resolved' ELSE 'unscoped' END AS reason,
  CASE WHEN a.d % 7 = 0 THEN list_concat(x.ids, coalesce(y.ids, [])) WHEN a.d % 7 = 5 THEN x.ids WHEN a.d % 7 = 3 AND y.k IS NOT NULL THEN y.ids WHEN a.d % 7 IN (2, 3, 4) THEN [a.document_id] ELSE [] END AS ids,
  CASE WHEN a.d % 7 IN (0, 5) THEN x.head WHEN a.d % 7 = 3 AND y.k IS NOT NULL THEN y.head WHEN a.d % 7 IN (2, 3, 4) THEN a.document_id END AS primary_id, CASE WHEN a.d % 7 = 0 AND y.k IS NOT NULL THEN 2 WHEN a.d % 7 IN (1, 6) THEN 0 ELSE 1 END AS n
  FROM docs a JOIN fam x ON a.k = x.k LEFT JOIN fam y ON a.k + 1 = y.k)"""


@query(f"""WITH {SCOPES} SELECT spec_id, reason, primary_id, CAST(n AS BIGINT) AS n_families, CASE WHEN reason = 'cross_document_comparison' THEN reason WHEN n = 1 OR starts_with(reason, 'deictic') THEN 'single_document' ELSE 'multi_document' END AS mode, CAST(len(ids) AS BIGINT) AS n_documents, list_aggregate(ids, 'min') AS first_id FROM scoped""", whole=True)
def document_scopes(t: Tables) -> DataFrame:
    scope, allowed = _scopes(t)
    sizes = allowed.groupBy("spec_id").agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_id"))
    return scope.drop("open").join(sizes, "spec_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


#: Each fact is a hit of the spec of its document, in this document or one of the next, by its page.
@query(f"""WITH {SCOPES}, hits AS (SELECT CAST(substr(document_id, 4) AS BIGINT) AS spec_id, 'doc' || CAST(CAST(substr(document_id, 4) AS BIGINT) + page_number - 1 AS VARCHAR) AS document_id FROM {{v_fact}} f)
SELECT spec_id, document_id, count(*) AS n FROM hits h JOIN scoped s USING (spec_id) WHERE reason = 'unscoped' OR list_contains(ids, document_id) GROUP BY ALL""", whole=True)
def scoped_hits(t: Tables) -> DataFrame:
    own = F.substring("document_id", 4, 20).cast("long")
    hits = t.fact.select(own.alias("spec_id"), F.concat(F.lit("doc"), (own + F.col("page_number") - 1).cast("string")).alias("document_id"))
    return S.in_scopes(hits, *_scopes(t)).groupBy("spec_id", "document_id").agg(F.count("*").alias("n"))
