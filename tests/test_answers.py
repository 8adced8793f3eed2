"""Facts first, bars, tables of evidence, a report's datasets, stored pages and table chunks against plain Python."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N
from lodestone.operators import answers as B
from lodestone.operators import corpus as C
from lodestone.operators import facts as X
from lodestone.operators import geology as E
from lodestone.operators import report as P
from lodestone.sources.store import page_table, write_report

FACT = "fact_id string, document_id string, entity_name string, metric string, reporting_month string, period string, measure string, table_title string"
SPEC = "spec_id int, entity string, prefers_numeric boolean, metrics array<string>, periods array<string>, months array<string>, measures array<string>"


def significant(name):
    return {w for w in re.sub(r"\s+", " ", name.lower().replace("-", " ")).strip().split(" ") if w not in ("", "mine", "mines", "ltd", "of", "the")}


def named(have, want):
    letters = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    a, b = significant(have), significant(want)
    return letters(have) == letters(want) or bool(b) and b <= a and len(a) <= len(b)


def relevance(title, metrics):
    t, score = (title or "").lower(), 0.0
    if "coal" in metrics:
        score += 0.45 if "coal" in t and "production" in t else 0.2 if "coal" in t else 0.0
        score -= 0.3 if "status" in t and "coal" not in t else 0.0
        score -= 0.35 if any(x in t for x in ("dispatch", "supply", "washed", "coking")) else 0.0
    score += 0.45 if "lignite" in metrics and "lignite" in t else 0.0
    score += 0.1 if re.search(r"table\s+\d", t) else 0.0
    return score - (0.2 if t.startswith("all figures") or "fig. in" in t else 0.0)


def first(facts, spec, k):
    _, entity, numeric, metrics, periods, months, measures = spec
    lists = [[x for x in xs or [] if x is not None] for xs in (metrics, periods, months, measures)]
    metrics, months, measures = ([x.lower() for x in lists[n]] for n in (0, 2, 3))
    periods, entity = lists[1], (entity or "").strip()
    if not numeric or not (entity or metrics):
        return []
    out = set()
    for f in facts:
        fid, doc, name, metric, month, period, measure, title = f
        if not name or not metric or entity and not named(name, entity):
            continue
        have = metric.lower()
        if metrics and not any(m in have.replace("_", " ") or m == "production" and have in ("coal", "lignite", "coking_coal") for m in metrics):
            continue
        if "coal" in metrics and have in ("lignite", "coking_coal"):
            continue
        met = next((p for p in periods if p == period), None)
        if periods and met is None or months and (month or "").lower() not in months or measures and (measure or "").lower() not in measures:
            continue
        worth = 1.2 + 0.35 * bool(entity) + 0.25 * bool(metrics) + 0.2 * bool(periods) + 0.25 * bool(months) + 0.15 * bool(measures)
        t = relevance(title, metrics)
        out.add((round(worth * 0.01 + t + (0.92 if periods else 0.9), 6), round(worth + t, 6), fid, doc, met))
    rows = sorted(out, key=lambda r: (-round(r[0] + r[1], 6), r[2], r[3]))[:k]
    return [(r[2], r[3], r[4], r[0], r[1]) for r in rows]


def test_facts_first(spark):
    rng = random.Random(5)
    names = ["Mine 7", "mine-7", "Mine 7 North", "North", "Moonidih", "", None, "The Mine"]
    titles = [None, "", "Table 1: Coal Production", "Coal stock", "Status of works", "Coal dispatch", "All figures in MT", "Lignite (fig. in MT)"]
    pick = rng.choice
    facts = [(f"f{n}", f"d{n % 3}", pick(names), pick(["coal", "lignite", "coking_coal", "coal_production", "overburden", None]), pick(["March", "june", None]), pick(["FY2023-24", "FY2024-25", None]), pick(["during", "target", None]), pick(titles)) for n in range(300)]
    facts += facts[:20]
    some = lambda xs: pick([None, [], [pick(xs)], [pick(xs), None, pick(xs)]])
    specs = [(n, pick(["Mine 7", "MINE 7 ", "7 north", "Moonidih", "nowhere", None, " "]), pick([True, True, True, False, None]), some(["coal", "Coal", "lignite", "production", "coking", "zinc"]), some(["FY2023-24", "FY2024-25"]), some(["March", "June"]), some(["during", "target"])) for n in range(120)]
    df = spark.createDataFrame(facts, FACT).withColumn("spec_id", F.lit(0)).withColumn("score", F.lit(1)).withColumn("entity", F.lit("x"))  # names that clash
    for k in (5, 1000):
        got = {}
        for r in B.fact_first(df, spark.createDataFrame(specs, SPEC), k).orderBy("spec_id", "rank").collect():
            got.setdefault(r.spec_id, []).append((r.fact_id, r.document_id, r.period, r.score, r.compat))
        want = {s[0]: first(facts, s, k) for s in specs}
        assert got == {k_: v for k_, v in want.items() if v}
        assert len(got) > 20
    assert B.fact_first(df.where("false"), spark.createDataFrame(specs, SPEC)).count() == 0
    assert B.fact_first(df, spark.createDataFrame([], SPEC)).count() == 0


def test_spellings_and_reasons(spark):
    facts = spark.createDataFrame([("f", "d", "Mine 7", "coal", "March", "FY2024-25", "during", "Coal production")], FACT)
    specs = spark.createDataFrame([(1, "Mine7", True, ["coal"], ["2024-25"], ["MARCH"], ["During"]), (2, "7 north", True, ["coal"], None, None, None)], SPEC)
    (r,) = B.fact_first(facts, specs).collect()
    assert (r.spec_id, r.period, r.rank) == (1, "2024-25", 1)
    assert r.reasons == ["entity_match", "metric_match", "period_match", "reporting_month_match", "measure_type_match", "title_relevance"]


def test_bars(spark):
    schema = "entity_name string, storage_metric string, measure string, source string, period string, value double, unit string, confidence double, fact_id string, document_id string"
    base = ("A", "coal", "during", "index", "FY2020-21", 1.0, "MT", 0.9, "a", "d")
    row = lambda **c: tuple(c.get(n, v) for n, v in zip([x.split()[0] for x in schema.split(", ")], base, strict=True))
    rows = [row(), row(period="FY2024-25", measure="upto", value=9.0, fact_id="b"), row(entity_name="a", value=2.0, fact_id="c"), row(entity_name="B", measure="upto", value=3.0, unit="mt", fact_id="e"), row(entity_name="C", value=None, fact_id="g"), row(entity_name="D", fact_id="h"), row(entity_name=None), row(entity_name="E", measure=None, source="extracted", period=None, unit=None, fact_id="i")]
    conflicts = spark.createDataFrame([("d", "Coal", None, "detected"), ("A", "coal", "x", "dismissed"), (None, None, None, None)], "entity_name string, field_name string, period string, status string")
    asked = spark.createDataFrame([(n,) for n in ("A", "a", "B", "C", "D", "E", None)], "entity_name string")
    show = lambda xs: {r.entity: (r.status, r.fact_id, r.value) for r in B.entity_bars(spark.createDataFrame(xs, schema), conflicts, asked, "coal").collect()}
    want = {"a": ("ok", "c", 2.0), "b": ("ok", "e", 3.0), "c": ("missing", None, None), "d": ("conflict", None, None), "e": ("ok", "i", 1.0)}
    assert show(rows) == want
    odd = show(rows + [row(entity_name="E", unit="kt", fact_id="z")])
    assert {k: v[0] for k, v in odd.items()} == {"a": "withheld", "b": "withheld", "c": "missing", "d": "conflict", "e": "withheld"}
    assert all(v[1:] == (None, None) for v in odd.values())
    assert {v[0] for v in show([row(entity_name="none")]).values()} == {"missing", "conflict"}


def test_evidence_table(spark):
    points = spark.createDataFrame([("a", "FY1", 1.0, "MT", "p"), ("a", "FY2", 2.0, None, None), ("b", "FY1", 3.0, None, "q")], "entity string, period string, value double, unit string, fact_id string")
    pairs = spark.createDataFrame([("a", "FY1", 5.0, 10.0, 50.0, "r"), ("c", "FY9", 7.0, 0.0, None, "r")], "entity string, period string, actual double, target double, achievement double, actual_id string")
    origins = spark.createDataFrame([("p", "d1", "kt", 4), ("r", "d2", "kt", None)], "fact_id string, document_id string, unit string, page int")
    documents = spark.createDataFrame([("d1", "One.pdf", 1)], "document_id string, filename string, version int")
    got = {(r.entity, r.period): tuple(r)[2:] for r in B.evidence_table(points, pairs, origins, documents).collect()}
    assert got == {
        ("a", "FY1"): (5.0, 10.0, 50.0, "MT", "p", "d1", "One.pdf", 4, None),
        ("a", "FY2"): (2.0, None, None, None, None, None, None, None, B.NO_EVIDENCE),
        ("b", "FY1"): (3.0, None, None, None, "q", None, None, None, None),
        ("c", "FY9"): (7.0, 0.0, None, "kt", "r", "d2", None, None, None),
    }


GEO = "id string, document_id string, metric_kind string, seam_name string, seam_status string, geological_formation string, borehole_id string, value_num double, length_unit string, source_page int, status string, evidence_text string"


def _geo(spark, rows):
    base = dict(id="x", document_id="d", metric_kind="resources", seam_name="R1", seam_status="named", geological_formation="Barakar Formation", borehole_id="BH-1", value_num=1.0, length_unit="m", source_page=1, status="extracted", evidence_text="e" * 600)
    return E.typed(spark.createDataFrame([base | r for r in rows], GEO))


def test_report(spark, tmp_path):
    rows = _geo(spark, [dict(id="1"), dict(id="2", status="approved", document_id="e"), dict(id="3", document_id="e"), dict(id="4", document_id="f", metric_kind="seam_thickness", status="rejected"), dict(id="5", document_id="g", metric_kind="seam_thickness", status="approved", evidence_text=None)])
    documents = spark.createDataFrame([("d", "D.pdf", 1), ("e", "E.pdf", 2)], "document_id string, filename string, version int")
    facts = spark.createDataFrame([("f1", "d", "A", "coal", 1.0, "MT", "FY1", 3)], "fact_id string, document_id string, entity_name string, metric string, value double, unit string, period string, page int")
    conflicts = spark.createDataFrame([("A", "coal", "FY1", "detected", "high"), ("B", "coal", "FY1", "resolved", "low")], "entity_name string, field_name string, period string, status string, severity string")
    parts = P.datasets(facts, rows, conflicts, documents)
    write_report(parts, str(tmp_path / "report"))
    read = {n: spark.read.parquet(str(tmp_path / "report" / n)).collect() for n in parts}
    assert {(r.document_id, r.warning) for r in read["Warnings"]} == {("d", P.WARNINGS["facts_pending"]), ("d", P.WARNINGS["resources_pending"]), ("d", P.WARNINGS["no_thickness"]), ("e", P.WARNINGS["no_thickness"]), ("f", P.WARNINGS["no_resources"]), ("f", P.WARNINGS["no_thickness"]), ("g", P.WARNINGS["no_resources"])}
    assert {r.fact_id for r in read["Resources"]} == {"1", "2"}
    assert {r.fact_id: r.requires_review for r in read["Geological_Facts"]} == {"1": True, "2": False, "3": True, "5": False}
    assert {r.fact_id: (r.status, r.evidence and len(r.evidence), r.document) for r in read["Evidence_Sources"]} == {"1": ("Needs review", 500, "D.pdf"), "2": ("Verified", 500, "E.pdf"), "3": ("Needs review", 500, "E.pdf"), "5": ("Verified", None, "g")}
    assert {r.metric: r["count"] for r in read["Audit_Review_Status"]} == {"review_required_count": 2, "rejected_excluded": 1, "pending_verification": 1, "open_conflicts": 1}
    assert {r.field: r.value for r in read["Summary"]}.items() >= {"documents": "3", "fact_count": "1", "geo_fact_count": "4", "open_conflicts": "1"}.items()
    assert [(r.entity, r.severity, r.description) for r in read["Validation_Conflicts"]] == [("A", "high", None)]
    assert [(r.document, r.page, r.status) for r in read["Facts_Metrics"]] == [("D.pdf", 3, "verified_structured")]
    assert [r.fact_id for r in P.evidence_sources(rows, documents, 2).orderBy("fact_id").collect()] == ["1", "2"]
    none = P.datasets(facts.where("false"), rows.where("false"), conflicts.where("false"), documents.where("false"))
    assert {n: df.count() for n, df in none.items()} == {"Summary": 9, "Facts_Metrics": 0, "Validation_Conflicts": 0, "Geological_Facts": 0, "Resources": 0, "Evidence_Sources": 0, "Audit_Review_Status": 4, "Warnings": 0}


def test_page_table(spark):
    new = spark.createDataFrame([("d", 1, None, None, "x"), ("e", 2, "añb", "Sheet1", "y")], "document_id string, page_number int, text string, sheet_name string, char_count string")
    stored = page_table(spark.createDataFrame([("d", 1, "old"), ("d", 2, "old"), ("f", 1, "kept")], "document_id string, page_number int, text string"))
    got = {(r.document_id, r.page_number): (r.text, r.source_location, r.char_count) for r in page_table(new, stored).collect()}
    assert got == {("d", 1): ("", "page 1", 0), ("e", 2): ("añb", "sheet Sheet1", 3), ("f", 1): ("kept", "page 1", 4)}
    assert page_table(new.where("false"), stored).count() == 3


def test_structured_chunks(spark):
    schema = "document_id string, entity string, metric string, reporting_month string, measurement_type string, fiscal_year string, value double, unit string, page int, table_id string, table_title string, column_path string"
    rows = [("d", "Odisha", "coal", "March", "during", "FY25", 12.5, "MT", 3, "t1", "Table 1", "FY25"), ("d", "Odisha", "coal", None, "upto", "FY25", 1234567.0, None, 3, "t1", "", "FY25")]
    documents = spark.createDataFrame([("d", "D.pdf", 2)], "document_id string, filename string, version int")
    a, b = C.structured_chunks(spark.createDataFrame(rows + rows[:1], schema), documents).orderBy("chunk_index").collect()
    assert a.content == "STRUCTURED_FACT | entity=Odisha | metric=coal | reporting_period=March | measure=during | fiscal_year=FY25 | value=12.5 | unit=MT | table=Table 1 | page=3 | column=FY25"
    assert "reporting_period=Unknown" in b.content and "value=1.23457e+06 | unit= | table=t1" in b.content
    assert (a.document_version, a.source_location, a.token_count) == (2, "page 3 / t1 / FY25", len(a.content.split()))
    assert json.loads(a.meta) | {"value": 12.5} == json.loads(a.meta) and a.chunk_id != b.chunk_id


def test_formats(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 10.0, 100000.0, 999999.5, 1e6, 0.0001, 0.00012345, 9.9999e-5, 123456789.0, -2.5, 1e300, 5e-324 * 2**60] + [rng.choice((-1, 1)) * rng.random() * 10 ** rng.randint(-8, 12) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double").orderBy("n").select(N.general(F.col("v"))).collect()]
    assert [g for g, v in zip(got, values, strict=True) if g != f"{v:g}".replace("-0", "0", v == 0)] == []
    texts = {"depth_of the  seam_in bh": "Depth of the Seam in Bh", "THE BCCL report": "THE BCCL Report", "boreHOLE": "Borehole", "": "", "of": "Of", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", N.title_words(F.col("t")).alias("x")).collect()} == texts
    places = {"DISTRICT : KOREA, CHHATTISGARH": True, "korea chhattisgarh": True, "District - Korea": True, "District Korea, Republic of": False, "Korea": False, "": False, None: False}
    df = spark.createDataFrame([(t,) for t in places], "t string")
    for r in df.select("t", G.location_label(F.col("t")).alias("label"), G.annotated(F.col("t")).alias("shown")).collect():
        assert (r.label is not None) == places[r.t]
        assert r.shown == (f"[{G.DISTRICT_LABEL}]\n{r.t}" if places[r.t] else r.t)


def test_metadata_of_chunks(spark):
    """Numbers, texts that hold numbers, other types, missing keys and broken texts."""
    texts = ['{"entity": " A ", "metric": "Coal", "value": 1.5, "page": 3, "confidence": 0.5}', '{"entity": "A", "metric": "coal", "value": "2.5", "page": "4"}', '{"entity": "A", "metric": "coal", "value": true}', '{"entity": "", "metric": "coal", "value": 1}', '{"entity": "A", "metric": "coal", "value": 1', "[1]", "", None, '{"entity": "A", "metric": "coal", "value": 3, "page": null, "confidence": "x", "reporting_month": " "}']
    rows = spark.createDataFrame([(str(n), "d", t, True, "structured_fact") for n, t in enumerate(texts)], "chunk_id string, document_id string, meta string, is_active boolean, content_type string")
    got = {r.chunk_id: (r.entity_name, r.metric, r.value, r.page, r.confidence, r.reporting_month) for r in X.index_facts(rows).collect()}
    assert got == {"0": ("A", "coal", 1.5, 3, 0.5, None), "1": ("A", "coal", 2.5, 4, 0.9, None), "8": ("A", "coal", 3.0, None, 0.9, None)}
