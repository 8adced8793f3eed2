"""Fact, document and chunk views over the star tables.

Each view is portable SQL with ``{table}`` placeholders: Spark fills them with DataFrames, other engines with names. ids are made of
the grain's keys, so that every row can be told apart. v_fact, v_document, v_index and v_conflict fold parts and suppliers into 50 mines
and 7 documents, so that only their own aggregates grow with the tables; their forms that end in _whole keep a mine for each part and a
document for each supplier, so that all that is built on them grows as well (most of their groups are of one row, so the status comes from keys)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_fact": """
SELECT document_id || '/' || entity_name || '/' || field_name || '/' || financial_year AS id, *,
       CAST(CAST(numeric_value AS BIGINT) AS VARCHAR(40)) AS value, false AS is_calculated
FROM (SELECT 'doc' || CAST(d AS VARCHAR(20)) AS document_id, 'Mine ' || CAST(e AS VARCHAR(20)) AS entity_name,
             CASE r WHEN 'A' THEN 'production' WHEN 'N' THEN 'production_target' ELSE 'dispatch' END AS field_name,
             'FY' || CAST(y AS VARCHAR(20)) AS financial_year, CASE WHEN d % 2 = 0 THEN q ELSE q * 1000000 END AS numeric_value,
             CASE WHEN d = 6 THEN NULL WHEN d % 2 = 0 THEN 'MT' ELSE 'tonnes' END AS unit,
             CASE n % 5 WHEN 0 THEN 'review_required' WHEN 1 THEN 'rejected' WHEN 2 THEN 'approved' WHEN 3 THEN 'corrected' ELSE 'high_confidence' END AS status,
             (CAST(ln AS DOUBLE) + 3) / 10 AS confidence_score, CAST(ln AS INT) AS page_number
      FROM (SELECT l_suppkey % 7 AS d, l_partkey % 50 AS e, l_returnflag AS r, year(l_shipdate) AS y, sum(l_quantity) AS q, min(l_linenumber) AS ln, count(*) AS n
            FROM {lineitem} GROUP BY l_suppkey % 7, l_partkey % 50, l_returnflag, year(l_shipdate)) b) f""",
    "v_document": """
SELECT 'doc' || CAST(d AS VARCHAR(20)) AS document_id, 'Report_' || CAST(d % 5 AS VARCHAR(20)) || '.pdf' AS filename,
       CASE WHEN d >= 5 THEN 2 ELSE 1 END AS version, CASE d % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' ELSE 'UPLOADED' END AS status, n AS weight
FROM (SELECT s_suppkey % 7 AS d, count(*) AS n FROM {supplier} GROUP BY s_suppkey % 7) b""",
    "v_upload": """
SELECT 'order' || CAST(o_orderkey AS VARCHAR(20)) AS document_id, 'file_' || CAST(o_custkey % 200 AS VARCHAR(20)) || '.pdf' AS filename, o_orderdate AS created_at, o_orderkey AS seq,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'UPLOADED' END AS status
FROM {orders}""",
    "v_index": """
SELECT 'c' || CAST(p AS VARCHAR(20)) || '/' || CAST(s AS VARCHAR(20)) || '/' || r || '/' || CAST(m AS VARCHAR(20)) || '/' || CAST(y AS VARCHAR(20)) || '/' || CAST(mo AS VARCHAR(20)) AS chunk_id, 'doc' || CAST(s AS VARCHAR(20)) AS document_id, 'Mine ' || CAST(p AS VARCHAR(20)) AS entity,
       CASE m WHEN 0 THEN 'Coal' WHEN 1 THEN 'lignite' ELSE 'Output' END AS metric, CASE r WHEN 'A' THEN 'during' WHEN 'N' THEN 'target' ELSE 'upto' END AS measurement_type,
       CAST(y AS VARCHAR(20)) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR(20)), 2, '0') AS fiscal_year, CASE mo WHEN 0 THEN 'March' WHEN 1 THEN 'June' ELSE NULL END AS reporting_month, CAST(q AS DOUBLE) AS value, 'MT' AS unit, CAST(ln AS INT) AS page
FROM (SELECT l_partkey % 50 AS p, l_suppkey % 7 AS s, l_returnflag AS r, l_linenumber % 3 AS m, year(l_shipdate) AS y, month(l_shipdate) % 3 AS mo, sum(l_quantity) AS q, min(l_linenumber) AS ln
      FROM {lineitem} GROUP BY l_partkey % 50, l_suppkey % 7, l_returnflag, l_linenumber % 3, year(l_shipdate), month(l_shipdate) % 3) b""",
    "v_geo": """
SELECT CAST(o AS VARCHAR(20)) || '/' || CAST(ln AS VARCHAR(20)) || '/' || CAST(p AS VARCHAR(20)) || '/' || CAST(s AS VARCHAR(20)) || '/' || CAST(CAST(q AS INT) AS VARCHAR(20)) AS id, 'doc' || CAST(s % 5 AS VARCHAR(20)) AS document_id,
       CASE z % 4 WHEN 0 THEN 'Raniganj Formation' WHEN 1 THEN 'the Barakar Formation' WHEN 2 THEN 'through the Formation' ELSE NULL END AS geological_formation,
       CASE WHEN z % 10 = 9 THEN NULL ELSE 'R' || CAST(z % 9 AS VARCHAR(20)) END AS seam_name, CASE WHEN z % 10 = 9 THEN 'uncorrelated' ELSE 'named' END AS seam_status, 'BH-' || CAST(p % 60 AS VARCHAR(20)) AS borehole_id,
       CASE ln % 5 WHEN 0 THEN 'seam_thickness' WHEN 1 THEN 'workable_thickness' WHEN 2 THEN 'borehole_depth' WHEN 3 THEN 'resources' ELSE 'formation' END AS metric_kind, q AS value_num,
       CASE CAST(q AS INT) % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'cm' ELSE 'ft' END AS length_unit, ln AS source_page,
       CASE CAST(q AS INT) % 4 WHEN 0 THEN 'review_required' WHEN 1 THEN 'rejected' WHEN 2 THEN 'approved' ELSE 'extracted' END AS status
FROM (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, l_quantity AS q, p_size AS z FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
      GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_size) b""",
    "v_conflict": """
SELECT DISTINCT 'Mine ' || CAST(l_partkey % 50 AS VARCHAR(20)) AS entity_name, CASE WHEN l_linenumber = 1 THEN 'production' ELSE 'dispatch' END AS field_name, 'FY' || CAST(year(l_shipdate) AS VARCHAR(20)) AS period,
       CASE WHEN l_quantity = 50 THEN 'review_required' ELSE 'dismissed' END AS status
FROM {lineitem} WHERE l_quantity >= 49 AND l_linenumber <= 2 AND l_discount > 0.08""",
    "v_review": """
SELECT 'r' || CAST(event_id AS VARCHAR(20)) AS action_id, ts AS acted_at, event_id AS seq, 'Mine ' || CAST(user_id % 50 AS VARCHAR(20)) AS entity_name, 'user' || CAST(user_id % 9 AS VARCHAR(20)) AS reviewer,
       CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'correct' END AS action, round(value, 2) AS corrected_value
FROM {events}""",
    "v_page": "SELECT 'd' || CAST(doc_id AS VARCHAR(20)) AS document_id, doc_id, coalesce(text, '') AS text, source FROM {documents}",
}

#: Pages whose tables lost their layout, in four forms: numbers after labels, labels and numbers apart, coking coal alone, actual and target in one block.
#: @0 to @2 stand for the numbers of a page, ~ for the end of a line.
_ROWS = "".join(f"{k + 1}~{label}~@{k}.10~@{k}.20~▲ 4.5~{extra}@{k}.30~@{k}.40~{last}▼ 1.25~" for k, (label, extra, last) in enumerate((("Odisha", "", ""), ("Jharkhand", "", ""), ("Telangana", "95.50~", "@2.50~"))))
_GRID = "".join(f"{k + 1}~@{k}.15~@{k}.25~@{k}.35~@{k}.45~" for k in range(3))
_FORMS = (
    f"Table 1.1: Coal Production in MT~Production during Mar~FY 25~FY 24~{_ROWS}Table 1.2",
    f"State-wise Lignite Production~as it stood upto Dec~Gujarat~1.5~Rajasthan~2.5~Kerala~3.5~FY 25~{_GRID}Assam~9.5",
    f"Coking Coal Production~FY 25~{_ROWS}End",
    "Production Performance~2023-24 Actual @0.11 @1.22 @2.33 9.44 9.55 9.66 9.77~@1.12 @2.23 @0.34 8.44 8.55 8.66 8.77",
)
VIEWS["v_layout_page"] = f"""
SELECT document_id, 1 AS page_number, form, n,
       replace(replace(replace(replace(CASE form WHEN 0 THEN '{_FORMS[0]}' WHEN 1 THEN '{_FORMS[1]}' WHEN 2 THEN '{_FORMS[2]}' ELSE '{_FORMS[3]}' END, '@0', CAST(n AS VARCHAR(20))), '@1', CAST(n + 1 AS VARCHAR(20))), '@2', CAST(n + 2 AS VARCHAR(20))), '~', chr(10)) AS text
FROM (SELECT 'y' || CAST(s AS VARCHAR(20)) || '/' || r AS document_id, CAST(s % 4 AS INT) AS form, n
      FROM (SELECT l_suppkey AS s, l_returnflag AS r, CAST(sum(l_quantity) AS INT) AS n FROM {{lineitem}} GROUP BY l_suppkey, l_returnflag) g) b"""

#: Questions about each mine and the next one, in six forms.
VIEWS["v_ask"] = """
SELECT p AS spec_id, CAST(p % 6 AS INT) AS form, 'Mine ' || CAST(p AS VARCHAR(20)) AS e1, 'Mine ' || CAST(p + 1 AS VARCHAR(20)) AS e2,
       'FY' || CAST(a AS VARCHAR(20)) || '-' || lpad(CAST((a + 1) % 100 AS VARCHAR(20)), 2, '0') AS first_period, 'FY' || CAST(z AS VARCHAR(20)) || '-' || lpad(CAST((z + 1) % 100 AS VARCHAR(20)), 2, '0') AS last_period
FROM (SELECT l_partkey % 50 AS p, min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS z FROM {lineitem} WHERE l_returnflag = 'A' AND l_linenumber % 3 = 0 GROUP BY l_partkey % 50) b"""

VIEWS |= {f"{v}_whole": VIEWS[v].replace("l_suppkey % 7", "l_suppkey").replace("l_partkey % 50", "l_partkey").replace("d = 6", "d % 7 = 6").replace("CASE n % 5", "CASE (d + e + y) % 5") for v in ("v_fact", "v_index", "v_conflict", "v_ask")}
#: Files of four versions each, so that the latest documents grow with the suppliers too.
VIEWS["v_document_whole"] = """
SELECT 'doc' || CAST(d AS VARCHAR(20)) AS document_id, 'Report_' || CAST(CAST((d - d % 4) / 4 AS BIGINT) AS VARCHAR(20)) || '.pdf' AS filename,
       CAST(d % 4 + 1 AS INT) AS version, CASE d % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' ELSE 'UPLOADED' END AS status, n AS weight
FROM (SELECT s_suppkey AS d, count(*) AS n FROM {supplier} GROUP BY s_suppkey) b"""

#: Pages of reports in six forms, with several facts, none, or the noise of recognition; their number grows with the tables.
VIEWS["v_report_page"] = """
SELECT 'p' || CAST(p AS VARCHAR(20)) || '/' || CAST(s AS VARCHAR(20)) || '/' || CAST(y AS VARCHAR(20)) AS document_id, 1 AS page_number, (p + s) % 3 = 0 AS is_ocr, CAST(q AS INT) AS q, CAST((p + s + y) % 6 AS INT) AS form, 'Production_Report_' || CAST(s % 3 AS VARCHAR(20)) || '.pdf' AS filename,
       CASE (p + s + y) % 6
         WHEN 0 THEN 'Annual report of NLC India. Mine ' || CAST(p AS VARCHAR(20)) || ' produced ' || CAST(CAST(q AS INT) AS VARCHAR(20)) || ' MT of coal during FY' || CAST(y AS VARCHAR(20)) || ' against a target of ' || CAST(CAST(q AS INT) + 5 AS VARCHAR(20)) || '.5 MT. Achievement of ' || CAST(CAST(q AS INT) + 40 AS VARCHAR(20)) || '.5 %. Mine 99 produced 1 MT during FY2001.'
         WHEN 1 THEN 'Scanned sheet' || chr(10) || 'Pr0ducti0n: ' || CAST(CAST(q AS INT) AS VARCHAR(20)) || '.9 M? of overburden'
         WHEN 2 THEN 'Mine | Production | Target' || chr(10) || 'Mine ' || CAST(p AS VARCHAR(20)) || ' | ' || CAST(CAST(q AS INT) AS VARCHAR(20)) || ' | ' || CAST(CAST(q AS INT) + 2 AS VARCHAR(20)) || '.25' || chr(10) || 'Mine X' || CAST(s AS VARCHAR(20)) || '|n.a.|' || CAST(CAST(q AS INT) AS VARCHAR(20)) || chr(10) || 'Total|1|2'
         WHEN 3 THEN 'Ore grade: ' || CAST(CAST(q AS INT) AS VARCHAR(20)) || '.5 % was met in the shale. Reserves of ' || CAST(CAST(q AS INT) AS VARCHAR(20)) || ' tonnes; reserve = 7 MT. The borehole and its coal seam lie in the formation.'
         WHEN 4 THEN 'The north pit' || chr(10) || 'Block-' || CAST(p AS VARCHAR(20)) || ' produced ' || CAST(CAST(q AS INT) AS VARCHAR(20)) || ' kt. Targets were not set. Achieved 12 % by May. Emission and safety were reviewed.'
         ELSE 'Nothing was told of output in this period.' END AS text
FROM (SELECT l_partkey AS p, l_suppkey AS s, year(l_shipdate) AS y, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey, l_suppkey, year(l_shipdate)) b"""

VIEWS["v_core_page"] = """
SELECT 'k' || CAST(s AS VARCHAR(20)) || '/' || r AS document_id, 1 AS page_number, 'BH-' || CAST(s AS VARCHAR(20)) AS borehole, 'R' || CAST(s % 9 + 1 AS VARCHAR(20)) AS seam, CAST(n AS VARCHAR(20)) AS n,
       'Borehole No. BH-' || CAST(s AS VARCHAR(20)) || ' was drilled to a depth of ' || CAST(n AS VARCHAR(20)) || '.5 m. Seam R' || CAST(s % 9 + 1 AS VARCHAR(20)) || ' was met; thickness ' || CAST(n AS VARCHAR(20)) || '.25 m. The hole was closed soon after. The minimum workable thickness considered is 0.90 m. Total coal resources of Seam R'
       || CAST(s % 9 + 1 AS VARCHAR(20)) || ' are ' || CAST(n AS VARCHAR(20)) || '.75 MT. The Barakar Formation follows.' AS text
FROM (SELECT l_suppkey AS s, l_returnflag AS r, CAST(sum(l_quantity) AS INT) AS n FROM {lineitem} GROUP BY l_suppkey, l_returnflag) b"""


def expanded(sql: str) -> str:
    """A query's text for an engine that knows the tables by name: {view} and {table} become their definitions and names."""

    def fill(m: re.Match) -> str:
        return f"({expanded(VIEWS[m[1]])})" if m[1] in VIEWS else m[1]

    return re.sub(r"\{(\w+)\}", fill, sql)


def tables(sql: str) -> set[str]:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return {t for n in names for t in (tables(VIEWS[n]) if n in VIEWS else {n})}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    return spark.sql(VIEWS[name].replace("VARCHAR(40)", "STRING").replace("VARCHAR(20)", "STRING"), **{t: table(spark, sf_dir, t) for t in tables(VIEWS[name])})
