"""Facets, ambiguous names, disagreeing ranges and the sparse search against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.operators import analytics as A
from lodestone.operators import retrieve as R
from lodestone.operators import validate as V


@pytest.mark.parametrize("criteria", [{}, {"entity": "b"}, {"entity": " B ", "metric": "production"}, {"commodity": "coal"}, {"metric": "coal", "commodity": "lignite"}, {"entity": "", "metric": "nothing"}])
def test_facets(spark, criteria):
    rnd = random.Random(1)
    names = ["entity_name", "commodity", "metric", "storage_metric", "measure", "period", "reporting_month"]
    of = [["A", "B", "Cc"], ["coal", "lignite", None], ["production", "dispatch", "overburden"], ["coal", "production_target", "dispatch", "stripping"], ["during", None], ["FY2001", "FY2002"], ["March", "june", None]]
    rows = [tuple(rnd.choice(v) for v in of) for _ in range(300)]
    got = {(r.axis, r.value): (r.n, r.n_open, r.score, r.listed) for r in A.facets(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), **criteria).collect()}
    asked = {k: v.strip().lower() for k, v in criteria.items() if v.strip()}
    tests = {"entity": lambda r: r["entity_name"].lower() == asked["entity"], "commodity": lambda r: r["commodity"] == asked["commodity"], "metric": lambda r: asked["metric"] in (r["metric"], r["storage_metric"])}
    own = {"entity_name": "entity", "commodity": "commodity", "metric": "metric", "legacy_metric": "metric"}
    want = {}
    for r in (dict(zip(names, r, strict=True)) for r in rows):
        r["legacy_metric"] = r["storage_metric"] if r["storage_metric"] in A.LEGACY_METRICS else None
        failed = {c for c in asked if not tests[c](r)}
        for axis in (*names, "legacy_metric"):
            if axis != "storage_metric" and r[axis] is not None:
                n, n_open, score, _ = want.get((axis, r[axis]), (0, 0, 0, False))
                n, n_open, score = n + (not failed), n_open + (not failed - {own.get(axis)}), score + (3 if r["storage_metric"] in A.CORE else 1)
                want[axis, r[axis]] = (n, n_open, score, n > 0 or axis in ("entity_name", "legacy_metric"))
    assert got == {k: (n, o, s if k[0] == "entity_name" else None, on) for k, (n, o, s, on) in want.items()}


def test_suggestions(spark):
    rows = [("Long name", "lignite", "dispatch", "coal", None, "p", "March 31"), ("B", "lignite", "dispatch", "coal", None, "p", "june"), ("A", None, "zinc", "zinc", None, "p", None)]
    kind = "entity_name string, commodity string, metric string, storage_metric string, measure string, period string, reporting_month string"
    assert tuple(A.suggested(A.facets(spark.createDataFrame(rows, kind))).first()) == ("B", "dispatch", "lignite", "March 31")
    assert tuple(A.suggested(A.facets(spark.createDataFrame(rows, kind), entity="A")).first()) == ("B", "zinc", None, None)
    assert tuple(A.suggested(A.facets(spark.createDataFrame([], kind))).first()) == (None,) * 4


def facts(spark, names):
    rows = [(f"{d}/{n}/{y}", d, n, "production", y, 1.0, "approved", "MT") for d, n, y in names]
    return spark.createDataFrame(rows, "id string, document_id string, entity_name string, field_name string, financial_year string, numeric_value double, status string, unit string")


def test_ambiguous_names(spark):
    rnd = random.Random(2)
    words = ["mine", "north", "south", "deep", "block", "ab", "cd", "x", "12", "123", "coalfield"]
    names = {(f"d{rnd.randrange(3)}", " ".join(rnd.sample(words, rnd.randint(1, 5))), f"FY200{rnd.randrange(2)}") for _ in range(150)} | {("d0", "x", "FY2000"), ("d1", "x y", "FY2000")}
    pairs = set()
    held = {}
    for d, n, y in names:
        held.setdefault((y, n), set()).add(d)
    for (y, a), (z, b) in itertools.combinations(sorted(held), 2):
        if y == z and (len(held[y, a]) > 1 or len(held[z, b]) > 1 or held[y, a] != held[z, b]):
            pairs.add((y, *sorted((a, b))))
    told = spark.createDataFrame(sorted(pairs), "period string, a string, b string").where(N.entity_match(F.col("a"), F.col("b")) == "ambiguous").collect()
    got = V.ambiguous_entities(facts(spark, sorted(names))).collect()
    assert len(got) > 30 and sorted((r.period, r.a_entity, r.b_entity) for r in got) == sorted(map(tuple, told))


def test_a_common_word_brings_no_pairs(spark):
    names = [(f"d{i % 5}", f"mine number{i:04}", "FY2000") for i in range(400)]
    plan = V.ambiguous_entities(facts(spark, names))
    assert plan.count() == 0
    words = {r.entity: list(r.words) for r in V.rarest_first(spark.createDataFrame([(n,) for _, n, _ in names], "entity string")).collect()}
    assert all(w[-1] == "mine" for w in words.values())


def test_ambiguous_names_read_facts_once(spark):
    """Facts are read once, and a pair that meets at several words comes once without a sort of all pairs."""
    names = [(f"d{i % 3}", f"mine number{i % 40:04} field{i % 4} block{i % 2}", "FY2000") for i in range(80)] + [("d0", "mine number0001", "FY2000")]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        read.add(1)
        return value

    rows = facts(spark, names).withColumn("numeric_value", seen.asNondeterministic()("numeric_value"))
    got = V.ambiguous_entities(rows)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    pairs = [tuple(r) for r in got.select("period", "a_entity", "b_entity").collect()]
    assert pairs and len(pairs) == len(set(pairs)) and read.value == len(names)


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_range_disagreements(spark, most):
    rnd = random.Random(3)
    rows = []
    for key in ("a", "b", "c"):
        for _ in range(1 if key == "c" else 120):
            low = rnd.choice([rnd.uniform(0, 50), rnd.randrange(0, 50)])
            rows.append((key, "m", "h", f"d{rnd.randrange(4)}", float(low), float(low + rnd.choice([0, 0, 1, 3, 20]))))
    rows += [rows[0], ("a", "m", "h", "d1", None, 3.0), ("a", "m", "h", "d1", 3.0, None), ("b", None, "h", "d1", 1.0, 2.0)]
    got = V.range_disagreements(spark.createDataFrame(rows, "entity_key string, metric string, borehole string, document_id string, low double, high double"), most=most).collect()
    want, kept = [], sorted({r for r in rows if r[1] and None not in r})
    for a in kept:
        others = [b for b in kept if b[:3] == a[:3] and (b[5] + 1e-6 < a[4] or a[5] + 1e-6 < b[4])]
        if others:
            gap = lambda b: (round(b[4] - a[5] if b[4] > a[5] else a[4] - b[5], 9), b[4] > a[5], b[3])
            near = min(others, key=gap)
            want.append((*a[:6], len(others), sum(b[3] == a[3] for b in others), near[3], *gap(near)[:1]))
    assert sorted((r.entity_key, r.metric, r.borehole, r.document_id, r.low, r.high, r.n, r.n_in_document, r.nearest_document, r.gap) for r in got) == sorted(want)
    assert all(r.severity == ("high" if r.n_in_document else "medium") for r in got)


def test_sparse_search(spark):
    """Block maxima change no result and save visits."""
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        topic = i % 20
        terms = {topic * 3 + rnd.randrange(3): rnd.choice([-1.0, 1.0, 2.0]) * 3, 60 + rnd.randrange(5): rnd.choice([-1.0, 1.0]), 70: 0.5}  # a term that all have
        norm = sum(w * w for w in terms.values()) ** 0.5
        rows += [(f"v{i:03}", t, w / norm) for t, w in terms.items()]
    df = spark.createDataFrame(rows, "id string, idx int, weight double").repartition(4)
    queries = df.where("id < 'v025'")
    by = {}
    for i, t, w in rows:
        by.setdefault(i, {})[t] = w
    want = []
    for q in sorted(by)[:25]:
        scores = sorted((-round(sum(w * v.get(t, 0) for t, w in by[q].items()), 6), i) for i, v in by.items() if v.keys() & by[q].keys())[:7]
        want += [(q, i, r) for r, (_, i) in enumerate(scores, 1)]
    got = sorted((r.query_id, r.id, r["rank"]) for r in R.sparse_top_k(queries, df, 7, size=10, first=2).collect())
    assert got == sorted(want)
    asked = queries.select(F.col("id").alias("query_id"), "idx", F.col("weight").alias("q"))
    postings = R.blocked(df, 10)
    bounds = {(r.query_id, r.block): r.bound for r in R.block_bounds(asked, postings).collect()}
    held = {r.id: r.block for r in postings.select("id", "block").distinct().collect()}
    least = {q: -sorted((-round(sum(w * v.get(t, 0) for t, w in by[q].items()), 6)) for v in by.values())[6] for q in sorted(by)[:25]}
    for q in least:
        for i, v in by.items():
            if v.keys() & by[q].keys():
                assert sum(w * v.get(t, 0) for t, w in by[q].items()) <= bounds[q, held[i]] + 1e-9
    reached = sum(b + 1e-6 >= least[q] for (q, _), b in bounds.items())
    assert reached < 0.5 * len(bounds)  # over half of all visits are left out
