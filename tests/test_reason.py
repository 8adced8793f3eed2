"""Slots, verdicts, packs and scopes against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import reason as Q

SPEC = "spec_id int, entities array<string>, metrics array<string>, months array<string>, periods array<string>, measures array<string>, mode string"
FACT = "fact_id string, entity_name string, metric string, reporting_month string, period string, measure string, value double, unit string, table_title string, page int"


def slots_of(spec):
    once = lambda xs: list(dict.fromkeys(x for x in xs or [] if x is not None))
    entities, metrics, months, periods, measures = map(once, spec[1:6])
    metrics = [m for m in metrics if m.lower() != "production"] or metrics
    if not periods and not (len(entities) == 1 and spec[6] in Q.YEARLY):
        periods = [None]
    return [(e, p, mo, k, m) for e in entities for p in periods for mo in months or [None] for k in measures or ["during"] for m in metrics]


def fills(f, slot):
    e, p, mo, k, m = slot
    words = [w for w in e.lower().split() if w != "mine"]
    if f[1].lower() != e.lower() and not (words and all(w in f[1].lower().split() for w in words)):
        return False
    have = f[2].lower()
    metric = {"coal": have in ("coal", "coal_production"), "lignite": have == "lignite", "production": "production" in have or have in ("coal", "lignite", "coking_coal")}.get(m, m in have or have in m)
    return metric and (mo is None or mo == f[3]) and f[5] == k and (p is None or f[4] == p)


def verdict(spec, facts):
    """(status, number of values, year, higher, lower, from, to, change, undefined)"""
    dims = {}
    for f in facts:
        if f[6] is not None:
            dims.setdefault(tuple((x or "").lower() for x in (f[1], f[2], f[3], f[4], f[5], f[7])), []).append(f)
    slots = slots_of(spec)
    preferred = lambda fs: min(fs, key=lambda f: (0 if f[8] and f[8].lower().startswith("table 1") else 1, f[9] or 0, f[0]))
    order = lambda f: (0 if f[8] and f[8].lower().startswith("table 1") else 1, f[9] or 0, f[0])
    hits = [[d for d in dims.values() if any(fills(f, s) for f in d)] for s in slots]
    aligned = len(dict.fromkeys(spec[1] or [])) > 1 and not spec[4]
    if any(max(f[6] for f in d) - min(f[6] for f in d) > 1e-6 for h in hits for d in h):
        return ("conflict",)
    if spec[6] is None:
        return ("ok",)
    if not slots:
        return ("insufficient",)
    year = None
    if aligned:
        entities = list(dict.fromkeys(spec[1]))
        by_year = {}
        for s, h in zip(slots, hits, strict=True):
            for d in h:
                f = preferred(d)
                by_year.setdefault(f[4], {}).setdefault(s[0], []).append(f)
        whole = [y for y, es in by_year.items() if len(es) == len(entities)]
        if not whole:
            return ("insufficient",)
        year = max(whole)
        chosen = [min(by_year[year][e], key=order) for e in entities]
    else:
        if not all(hits):
            return ("insufficient",)
        chosen = [min(map(preferred, h), key=order) for h in hits]
    if len({f[7].lower() for f in chosen}) > 1:
        return ("unit_mismatch",)
    names, years = {f[1].lower() for f in chosen}, {f[4] for f in chosen}
    higher = lower = old = new = None
    if len(chosen) >= 2 and len(names) == 1 and len(years) >= 2 and not aligned:
        rows = sorted(chosen, key=lambda f: f[4])
        old, new = rows[0], rows[-1]
        if old[6] != new[6]:
            higher, lower = (new[4], old[4]) if new[6] > old[6] else (old[4], new[4])
        ends = (old[4], new[4])
    elif len(chosen) >= 2 and len(names) > 1:
        rows = sorted(chosen, key=lambda f: -f[6])
        higher, lower = rows[0][1], rows[-1][1]
        if len(chosen) == 2:
            old, new = rows[-1], rows[0]
            ends = (old[1], new[1])
    if old is None:
        return ("ok", len(chosen), year and year.lower(), higher, lower, None, None, None, None)
    return ("ok", len(chosen), year and year.lower(), higher, lower, *ends, new[6] - old[6], old[6] == 0)


def test_verdicts_equal_plain_python(spark):
    rng = random.Random(5)
    names = ["Mine 1", "Mine 2", "North Mine 2", "Mine 3", "The Mine"]
    facts = [(f"f{k:04}", rng.choice(names), rng.choice(["coal", "lignite", "coal_production", "Overburden"]), rng.choice([None, "March"]), rng.choice(["FY2021", "FY2022", "FY2023"]), rng.choice(["during", "target"]), float(rng.choice([0, 1, 1, 2])) if rng.random() < 0.95 else None, rng.choice(["MT", "MT", "MT", "MT", "t"]), rng.choice([None, "Table 1.2", "Totals"]), rng.choice([None, 1, 2])) for k in range(60)]
    several = lambda xs, least=0: rng.sample(xs, rng.randint(least, 2))
    specs = [(k, several(names), several(["coal", "lignite", "production", "overburden"]), several(["March"][:1] * 1 + ["June"]) if rng.random() < 0.3 else [], several(["FY2021", "FY2022", "FY2023"]), rng.choice([None, [], ["target"], ["during", "target"]]), rng.choice(["change", "compare", "rank", None, "other"])) for k in range(300)]
    for rows in (facts, facts[:25], facts[:8], []):
        got = {r["spec_id"]: r for r in Q.reasoned(spark.createDataFrame(specs, SPEC), spark.createDataFrame(rows, FACT)).collect()}
        assert len(got) == len(specs)
        seen = set()
        for s in specs:
            want, r = verdict(s, rows), got[s[0]]
            assert r["status"] == want[0], (s, want, r)
            seen.add(want[0])
            if len(want) > 1:
                assert (r["n_values"], r["year"], r["higher"], r["lower"], r["from_label"], r["to_label"], r["change"], r["percent_undefined"]) == want[1:], (s, want, r)
        assert len(seen) >= (4 if rows is facts else 1)


def test_slots_states_and_odd_rows(spark):
    facts = [("a", "Mine 1", "coal", None, "FY2021", "during", 3.0, "MT", None, 4), ("b", "MINE 1", "Coal", "March", "FY2022", "during", 5.0, "MT", None, 1), ("c", "Mine 1", "coal", "March", "FY2022", "during", 6.0, "MT", None, 2), ("d", None, None, None, None, None, 1.0, None, None, None), ("e", "Mine 1", "coal", None, "FY2023", "during", float("nan"), "MT", None, 1)]
    specs = [(1, ["mine 1", None, "mine 1"], ["production", "coal"], None, ["FY 2021", "FY2022", "2023"], None, "change"), (2, None, None, None, None, None, "change"), (3, [], ["coal"], [], [], [], None)]
    df = spark.createDataFrame(facts, FACT).withColumn("slot", F.lit(1)).withColumn("best", F.lit("x"))  # columns of clashing names
    got = [tuple(r) for r in Q.filled_slots(spark.createDataFrame(specs, SPEC), df.unionByName(df)).orderBy("spec_id", "slot").collect()]
    assert got == [(1, 0, "mine 1", "coal", None, "FY 2021", "during", "value", "a", 3.0, "MT", None, None), (1, 1, "mine 1", "coal", None, "FY2022", "during", "conflict", None, None, None, 5.0, 6.0), (1, 2, "mine 1", "coal", None, "2023", "during", "missing", None, None, None, None, None)]
    rows = {r["spec_id"]: r for r in Q.reasoned(spark.createDataFrame(specs, SPEC), df).collect()}
    assert [rows[k]["status"] for k in (1, 2, 3)] == ["conflict", "insufficient", "ok"]
    lost = Q.reasoned(spark.createDataFrame(specs[:1], SPEC), df.where("fact_id = 'a'")).first()
    assert lost["status"] == "insufficient" and lost["missing"] == ["mine 1 coal FY2022 during", "mine 1 coal 2023 during"]


def test_disagreements(spark):
    facts = [(f"f{k}", "A", "coal", None, "FY2021", "during", float(k % 9), "MT", None, 1) for k in range(30)] + [("x", "B", "coal", None, None, None, 1.0, None, None, 1), ("y", "B", "coal", None, None, None, 1.0 + 1e-9, None, None, 1)]
    (r,) = Q.disagreements(spark.createDataFrame(facts, FACT)).collect()
    assert (r["entity_name"], r["n_values"], [(e["value"], e["fact_id"], e["n_facts"]) for e in r["evidence"]]) == ("A", 9, [(0.0, "f0", 4), (1.0, "f1", 4), (2.0, "f11", 4), (3.0, "f12", 3), (4.0, "f13", 3), (5.0, "f14", 3)])
