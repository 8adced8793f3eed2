"""Queries of pages whose tables lost their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import layout as Y
from lodestone.plans.catalog import Tables, query

#: The numbers of each label, as the pages' forms list them.
ROWS = """listed AS (SELECT document_id, 'coal' AS metric, 'March' AS month, u.k AS pos, ['Odisha', 'Jharkhand', 'Telangana'][u.k] AS label, CASE WHEN u.k < 3 THEN [n + u.k - 1 + 0.10, n + u.k - 1 + 0.20, n + u.k - 1 + 0.30, n + u.k - 1 + 0.40] ELSE [n + 2.20, n + 2.30, n + 2.40, n + 2.50] END AS vs FROM {v_layout_page} p, (SELECT unnest([1, 2, 3]) AS k) u WHERE form = 0
UNION ALL SELECT document_id, 'lignite', 'December', u.k, ['Gujarat', 'Rajasthan', 'Kerala'][u.k], [n + u.k - 1 + 0.15, n + u.k - 1 + 0.25, n + u.k - 1 + 0.35, n + u.k - 1 + 0.45] FROM {v_layout_page} p, (SELECT unnest([1, 2, 3]) AS k) u WHERE form = 1)"""


@query(f"""WITH {ROWS} SELECT document_id, label, metric, month, measure, year, CAST(vs[i] AS DOUBLE) AS value FROM listed, (SELECT * FROM (VALUES ('during', 'later', 1), ('during', 'earlier', 2), ('upto', 'later', 3), ('upto', 'earlier', 4)) t(measure, year, i)) m""")
def period_tables(t: Tables) -> DataFrame:
    return Y.period_tables(t.layout_page).select("document_id", "label", "metric", "month", "measure", "year", "value")


@query(f"""WITH {ROWS}, said AS (SELECT document_id, metric, pos, 0 AS o, label || ' ' || metric || ' production | reporting_period=' || month || ' | measure=during | FY25=' || CAST(CAST(vs[1] AS DOUBLE) AS VARCHAR) || ' MT | FY24=' || CAST(CAST(vs[2] AS DOUBLE) AS VARCHAR) || ' MT.' AS line FROM listed
UNION ALL SELECT document_id, metric, pos, 1, label || ' ' || metric || ' production | reporting_period=' || month || ' | measure=upto | FY25=' || CAST(CAST(vs[3] AS DOUBLE) AS VARCHAR) || ' MT | FY24=' || CAST(CAST(vs[4] AS DOUBLE) AS VARCHAR) || ' MT.' FROM listed)
SELECT document_id, CASE metric WHEN 'coal' THEN 'Production table (reconstructed from source layout): ' ELSE 'State-wise coal production (reconstructed from source table): ' END || string_agg(line, ' ' ORDER BY pos, o) AS content FROM said GROUP BY document_id, metric""")
def period_table_texts(t: Tables) -> DataFrame:
    return Y.period_table_texts(Y.period_tables(t.layout_page)).select("document_id", "content")


@query("""SELECT document_id, ['Overburden', 'Lignite', 'Coal', 'Power Gross (NLCIL)', 'Power Export (NLCIL)', 'Power Gross (NTPL)', 'Power Export (NTPL)'][k] AS measure, CAST([n + 0.11, n + 1.22, n + 2.33, 9.44, 9.55, 9.66, 9.77][k] AS DOUBLE) AS actual, CAST([n + 1.12, n + 2.23, n + 0.34, 8.44, 8.55, 8.66, 8.77][k] AS DOUBLE) AS target FROM {v_layout_page} p, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k) u WHERE form = 3""")
def actual_target_blocks(t: Tables) -> DataFrame:
    return Y.actual_target_blocks(t.layout_page.where(F.contains("text", F.lit("Actual")))).select("document_id", "measure", "actual", "target")
