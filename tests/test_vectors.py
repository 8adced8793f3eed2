"""Exact vector search: blocks of queries meet blocks of rows as matrices, with the rows that the pairs give one by one."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import retrieve as R

SCHEMA = "id string, vector array<double>"


def one_by_one(queries, rows, k, least):
    pairs = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("a")).crossJoin(rows).select("query_id", "id", F.round(R.cosine(F.col("a"), F.col("vector")), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


@pytest.mark.parametrize("least", [-1.0, 0.28])
def test_blocks_find_what_pairs_find(spark, least):
    x = np.random.default_rng(3).integers(-3, 4, size=(120, 3)).astype(float)
    odd = [None, [], [1.0], [1.0, None, 0.0], [0.0, 0.0, 0.0], [1.0, float("nan"), 0.0], [float("inf"), 1.0, 1.0], [1e200, 1e200, 0.0], [1e-200, 0.0, 0.0], [None]]
    rows = spark.createDataFrame([(f"é{n}" if n % 5 == 0 else f"r{n}", v) for n, v in enumerate(x.tolist())] + [(f"odd{n}", v) for n, v in enumerate(odd)] + [(None, [1.0, 2.0, 3.0])], SCHEMA)
    queries = rows.where("id is not null and (id like '%7' or id like 'odd%')")
    got = R.exact_top_k(queries, rows, 6, least, block=16)
    tell = lambda df: sorted((r.query_id, r["rank"], str(r.id), str(r.score + 0.0)) for r in df.collect())
    assert tell(got) == tell(one_by_one(queries, rows, 6, least))


def test_no_pair_is_a_row(spark):
    rows = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(50)], "id long, vector array<float>")
    found = R.exact_top_k(rows.where("id < 5"), rows, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
    assert found.count() == 15 and R.exact_top_k(rows.where("false"), rows, 3).count() == 0 and R.exact_top_k(rows, rows.where("false"), 3).count() == 0
