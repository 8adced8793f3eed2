"""Texts that lost their layout, and evidence for specs, on literal rows."""

from pyspark.sql import functions as F

from lodestone.operators import evidence as D
from lodestone.operators import geology as E
from lodestone.operators import layout as Y

PAGE = "document_id string, page_number int, text string"


def test_two_passes(spark):
    base = spark.createDataFrame([("d", 1, "Actual 12.64 25.68 151.24 23803.14 end 25.68"), ("e", 1, "1.00 2.00")], PAGE)
    detail = spark.createDataFrame([("d", 1, "12.64 23.68 151.24 23803.14"), ("e", 1, "1.00 2.08")], PAGE)
    out = {r.document_id: r.text for r in Y.apply_replacements(base, Y.reconciled(base, detail)).collect()}
    assert out == {"d": "Actual 12.64 23.68 151.24 23803.14 end 23.68", "e": "1.00 2.00"}
    one = spark.range(1)
    same = lambda a, b: one.select(Y.confusable(F.lit(a), F.lit(b))).first()[0]
    assert same("25.68", "23.68") and not same("25.68", "26.50") and not same("25.68", "2568")


def test_interleaved_lines(spark):
    text = "Table 1.1: Coal Production\nFY 25\nAlpha Co\n1.10\n0.90\n+22.2%\n11.00\n9.00\nBeta Co\n2.10\n1.90\n21.00\n19.00\nNotes\n3.3"
    rows = Y.period_rows(Y.label_runs(spark.createDataFrame([("d", 1, text)], PAGE))).collect()
    assert {(r.label, r.measure, r.year, r.value) for r in rows} == {(n, m, y, v) for n, vs in (("Alpha Co", (1.1, 0.9, 11.0, 9.0)), ("Beta Co", (2.1, 1.9, 21.0, 19.0))) for (m, y), v in zip((("during", "later"), ("during", "earlier"), ("upto", "later"), ("upto", "earlier")), vs, strict=True)}


def test_grid_in_order(spark):
    text = "Alpha Co\n5.00\nBeta Co\n6.00\nFY 25\n1\n1.10\n0.90\n11.00\n9.00\n2\n2.10\n1.90\n21.00\n19.00"
    rows = Y.zipped_grid(spark.createDataFrame([("d", 1, text)], PAGE)).collect()
    assert {(r.label, tuple(r["values"])) for r in rows} == {("Alpha Co", (1.1, 0.9, 11.0, 9.0)), ("Beta Co", (2.1, 1.9, 21.0, 19.0))}


def test_actual_target_block(spark):
    text = "Actual 151.24 23.68 12.64 5.00 4.00 3.00 2.00 Target 167.13 26.50 12.00 5.10 4.10 3.10 2.10"
    rows = {r.measure: (r.actual, r.target) for r in Y.actual_target_blocks(spark.createDataFrame([("d", 1, text)], PAGE)).collect()}
    assert rows["Overburden"] == (151.24, 167.13) and rows["Lignite"] == (23.68, 26.50) and rows["Coal"] == (12.64, 12.00) and len(rows) == 7
    alone = text.replace("Target ", "")
    rows = {r.measure: (r.actual, r.target) for r in Y.actual_target_blocks(spark.createDataFrame([("d", 1, alone)], PAGE)).collect()}
    assert rows["Coal"] == (12.64, 12.00)


def test_page_statistics(spark):
    words = spark.createDataFrame([("d", 1, 0, "ok", 90.0), ("d", 1, 1, "bad", 50.0), ("d", 1, 2, "12.5", 60.0), ("d", 1, 3, "none", -1.0)], "document_id string, page_number int, place int, word string, confidence double")
    (r,) = Y.page_confidence(words).collect()
    assert (r.mean_confidence, r.low_words, r.low_decimals) == (66.667, ["bad", "12.5"], ["12.5"])
    pages = spark.createDataFrame([("d", 1, "x" * 100), ("e", 1, "  x ")], PAGE)
    assert {r.document_id: r.is_scanned for r in Y.scanned(pages).collect()} == {"d": False, "e": True}


def test_factual_role(spark):
    one = spark.range(1)
    role = lambda text: one.select(D.factual_role(F.lit(text), F.lit("CIL"))).first()[0]
    assert role("In the year CIL produced 12.5 MT of coal")
    assert not role("A joint venture of CIL was formed")
    assert not role("Nothing of the kind 12.5 production")


def test_verdicts(spark):
    schema = "spec_id int, label string, value double, unit string, conflict boolean"
    rows = [(1, "FY2024", 88.58, "MT", False), (1, "FY2025", 85.81, "MT", False), (2, "a", 1.0, "MT", False), (2, "b", None, None, None), (3, "a", 1.0, "MT", True), (4, "a", 1.0, "MT", False), (4, "b", 2.0, "MU", False)]
    out = {r.spec_id: r for r in D.compared(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.status for k, r in out.items()} == {1: "ok", 2: "insufficient", 3: "conflict", 4: "unit_mismatch"}
    assert (out[1].higher, out[1].change) == ("FY2024", 2.77)


def test_anchors(spark):
    measures = spark.createDataFrame([("d", 1, 500, "m1"), ("d", 1, 20, "m2"), ("d", 1, 5000, "m3")], "document_id string, page_number int, position int, measure string")
    anchors = spark.createDataFrame([("d", 1, 450, "before"), ("d", 1, 510, "after"), ("d", 1, 90, "ahead")], "document_id string, page_number int, position int, anchor string")
    assert {r.measure: r.anchor for r in D.nearest_anchor(measures, anchors).collect()} == {"m1": "before", "m2": "ahead"}


def test_choices(spark):
    names = spark.createDataFrame([("Zeta Mining Limited",), ("ABC",), ("Pit9",)], "entity_name string")
    assert D.chosen_entity(names).first()[0] == "ABC"
    facts = spark.createDataFrame([("1", "x", None, 1), ("2", "x", "Table 4: y", 9), ("3", "x", "Table 5", 3)], "fact_id string, k string, table_title string, page int")
    assert D.preferred(facts, ["k"]).first()["fact_id"] == "3"
    ranges = spark.createDataFrame([("1", "d", 1, 1.0, 2.0, 0.5), ("2", "d", 1, 1.0, 2.0, 0.9)], "id string, document_id string, page_number int, low double, high double, score double")
    assert [r.id for r in D.best_ranges(ranges).collect()] == ["2"]


def test_locations(spark):
    facts = spark.createDataFrame([("1", "d", 9, "at Latitude 23.5 Longitude 87.1"), ("2", "d", 3, "at Latitude 24.5 Longitude 88.1"), ("3", "e", 1, "nowhere")], "id string, document_id string, source_page int, evidence_text string")
    documents = spark.createDataFrame([("d", None), ("e", "lat: 10.0, lon: 20.0"), ("f", "lat: 99.0, lon: 20.0")], "document_id string, meta_text string")
    assert {(r.document_id, r.latitude, r.longitude) for r in E.locations(facts, documents).collect()} == {("d", 24.5, 88.1), ("e", 10.0, 20.0)}


def test_hooks(spark):
    chunks = spark.createDataFrame([("c", "abc"), ("d", None)], "chunk_id string, content string")
    assert {r.chunk_id: r.embedding for r in D.embedded(chunks, lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()} == {"c": [3.0, 1.0], "d": [0.0, 1.0]}
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], PAGE)
    drafts = D.extracted(pages, lambda rows: [{"document_id": r["document_id"], "value": r["text"]} for r in rows], "document_id string, value string")
    assert {r.value for r in drafts.collect()} == {"x", "y"}


def test_pages_and_topics(spark):
    rows = spark.range(10).withColumnRenamed("id", "n")
    assert [(r.n, r.total) for r in D.page_of(rows, ["n"], 2, 3).orderBy("n").collect()] == [(3, 10), (4, 10)]
    chunks = spark.createDataFrame([("c1", "d", "Coal text"), ("c2", "d", "Coal text"), ("c3", "e", "More coal")], "chunk_id string, document_id string, content string")
    evidence = chunks.select("chunk_id", "document_id", F.lit("coal").alias("topic"), F.lit(0.5).alias("score"))
    (r,) = D.topic_summary(evidence, chunks).collect()
    assert r.summary == "Coal text\nMore coal" and r.documents == ["d", "e"]
    kinds = chunks.withColumn("content_type", F.when(F.col("chunk_id") == "c1", "structured_fact").otherwise("text"))
    assert {r.chunk_id for r in D.browse_chunks(kinds, "COAL").collect()} == {"c2", "c3"}


def test_measured_rows_stay_apart(spark):
    schema = "id string, document_id string, metric_kind string, seam_name string, seam_status string, geological_formation string, borehole_id string, value_num double, length_unit string, source_page int, status string, confidence double"
    base = dict(document_id="d", metric_kind="borehole_depth", seam_name="R1", seam_status="named", geological_formation="Barakar Formation", borehole_id="BH-1", value_num=9.0, length_unit="m", source_page=1, status="extracted", confidence=0.5)
    changes = [{}, {"confidence": 0.9}, {"seam_name": "R2"}, {"source_page": 2}, {"status": "approved"}, {"document_id": "e"}, {"borehole_id": "BH-2"}, {"value_num": 8.0}]
    rows = E.typed(spark.createDataFrame([base | c | {"id": str(n)} for n, c in enumerate(changes)], schema))
    assert {r.id for r in D.geological_evidence(rows, "borehole_depth").collect()} == set("1234567")
    assert {r.id for r in D.geological_evidence(rows, "borehole_depth", k=3).collect()} == {"4", "1", "2"}
    quantities = rows.withColumn("kind", F.lit("resource_quantity"))
    assert {r.id for r in D.geological_evidence(quantities, "resources").collect()} == set("1234567")
    seams = rows.withColumn("kind", F.lit("seam"))
    assert sorted((r.document_id, r.seam) for r in D.geological_evidence(seams, "seam").collect()) == [("d", "Seam R1"), ("d", "Seam R2"), ("e", "Seam R1")]


def test_every_spec_meets_every_text(spark):
    specs = spark.range(2_500).select(F.col("id").alias("spec_id"), F.concat(F.lit("Pit"), F.col("id").cast("string")).alias("entity"), F.lit("production").alias("metric"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("month"))
    texts = spark.range(0, 2_500, 100).select(F.col("id").cast("string").alias("document_id"), F.concat(F.lit("Pit"), F.col("id").cast("string"), F.lit(" production")).alias("content"))
    want = {(n, str(n)) for n in range(0, 2_500, 100)}
    assert {(r.spec_id, r.document_id) for r in D.text_compatible(texts, specs).collect()} == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.spec_id, r.document_id) for r in D.text_compatible(texts, specs).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_period_tables(spark):
    rows = lambda *labels: "\n".join(f"{k + 1}\n{name}\n{k + 1}.10\n▲ 2.5\n{k + 1}.20\n{k + 1}.30\n{k + 1}.40" for k, name in enumerate(labels))
    head = "Table 1.1: Coal Production\nduring Mar\nFY 25\nFY 24\n"
    three = rows("Odisha", "Assam", "Kerala")
    grid = "State-wise coal production\nupto Dec\nOdisha\n9.10\nAssam\n9.20\nKerala\n9.30\nFY 25\n" + "\n".join(f"{k}\n{k}.10\n{k}.20\n{k}.30\n{k}.40" for k in (1, 2, 3)) + "\nBihar\n8.80"
    pages = {
        "plain": head + three,
        "two": head + rows("Odisha", "Assam"),
        "no year": head.replace("FY", "Y") + three,
        "no metal": "Production\nFY 25\n" + three,
        "coking": "Coking coal production\nFY 25\n" + three,
        "stripping": "OBR and coal\nproduction\nFY 25\n" + three,
        "section": head + three + "\nTable 1.1 (b) coking coal production\n" + rows("Bihar", "Gujarat"),
        "grid": grid,
        "by state": "State-wise coal production\nFY 25\n" + three,
        "achieved": head + three + "\nBihar\n5.10\n5.20\n98.00\n5.30\n5.40\n5.50",
        "null": None,
        "empty": "",
    }
    df = spark.createDataFrame([(k, 1, t, "x") for k, t in pages.items()], PAGE + ", values string")
    out = Y.period_tables(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.document_id, {}).setdefault((r.label, r.measure, r.year), r.value)
        assert (r.metric, r.month) == ("coal", {"grid": "December", "by state": "Unknown"}.get(r.document_id, "March"))
    want = {(name, m, y): k + 1 + v for k, name in enumerate(("Odisha", "Assam", "Kerala")) for m, y, v in (("during", "later", 0.1), ("during", "earlier", 0.2), ("upto", "later", 0.3), ("upto", "earlier", 0.4))}
    same = lambda a, b: a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert got.keys() == {"plain", "section", "grid", "by state", "achieved"}
    assert all(same(got[k], want) for k in ("plain", "section", "grid", "by state"))
    assert same(got["achieved"], want | {("Bihar", "during", "later"): 5.2, ("Bihar", "during", "earlier"): 5.3, ("Bihar", "upto", "later"): 5.4, ("Bihar", "upto", "earlier"): 5.5})
    texts = {r.document_id: r.content for r in Y.period_table_texts(out).collect()}
    assert texts["grid"].startswith("State-wise coal production (reconstructed from source table): Odisha coal production | reporting_period=December | measure=during | FY25=1.1 MT | FY24=1.2 MT. Odisha coal")
    assert Y.period_tables(df.where("false")).count() == 0
