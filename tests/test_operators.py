"""Operators on literal rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analytics as A
from lodestone.operators import corpus as C
from lodestone.operators import extract as T
from lodestone.operators import facts as X
from lodestone.operators import geology as E
from lodestone.operators import retrieve as R
from lodestone.operators import review as W
from lodestone.operators import validate as V
from lodestone.sources import store
from lodestone.streaming import ingest

FACT = "id string, document_id string, field_name string, numeric_value double, unit string, entity_name string, financial_year string, confidence_score double, status string, is_calculated boolean"


@pytest.fixture
def facts(spark):
    return lambda *rows: spark.createDataFrame([(i, d, f, v, u, e, y, 0.9, s, False) for i, d, f, v, u, e, y, s in rows], FACT)


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([("docA", "a.pdf", 1), ("docB", "b.pdf", 1), ("docA2", "A.pdf", 2)], "document_id string, filename string, version int")


def test_trend_keeps_verified_years(facts):
    rows = facts(*[(f"f{y}", "docA", "output", v, "MT", "Mine B", f"FY{y}", "high_confidence") for y, v in ((2022, 4.0), (2023, 4.5), (2024, 5.2))], ("bad", "docA", "output", 9.0, "MT", "Mine B", "FY2025", "review_required"))
    points = A.trend(X.normalized(X.verified(rows))).orderBy("period").collect()
    assert [(p.period, p.numeric_value, p.chart_type) for p in points] == [("FY2022", 4.0, "line"), ("FY2023", 4.5, "line"), ("FY2024", 5.2, "line")]


def test_contradictions(facts, documents):
    differ = facts(("1", "docA", "production", 5.2, "MT", "Mine B", "FY2024", "approved"), ("2", "docB", "output", 6.2, "MT", "mine-b", "2024", "approved"))
    (row,) = V.cross_document(differ, documents).collect()
    assert row.conflict_type == "contradiction" and row.fingerprint == hashlib.sha256(b"contra|mine b|production|FY2024|docA|docB").hexdigest()[:40]
    same = facts(("1", "docA", "production", 5.2, "MT", "Mine B", "FY2024", "approved"), ("2", "docB", "production", 5_200_000.0, "t", "Mine B", "FY2024", "approved"))
    assert V.cross_document(same, documents).count() == 0
    units = facts(("1", "docA", "production", 5.2, "MT", "Mine B", "FY2024", "approved"), ("2", "docB", "production", 5.2, "%", "Mine B", "FY2024", "approved"))
    assert [r.conflict_type for r in V.cross_document(units, documents).collect()] == ["unit_review"]
    other = facts(("1", "docA", "production", 5.2, "MT", "Mine B", "FY2024", "approved"), ("2", "docB", "production", 6.2, "MT", "Mine A", "FY2024", "approved"))
    assert V.cross_document(other, documents).count() == 0
    newer = facts(("1", "docA", "production", 5.2, "MT", "Mine B", "FY2024", "approved"), ("2", "docA2", "production", 6.2, "MT", "Mine B", "FY2024", "approved"))
    assert V.cross_document(newer, documents).count() == 0  # one file


def test_achievement(facts):
    rows = facts(("1", "docA", "production", 3.9, "MT", "Mine B", "FY2024", "approved"), ("2", "docA", "target", 5.0, "MT", "Mine B", "FY2024", "approved"), ("3", "docA", "achievement", 90.0, "%", "Mine B", "FY2024", "approved"))
    (row,) = V.achievement_discrepancies(rows).collect()
    assert (row.calculated, row.reported) == (78.0, 90.0)
    assert [r.numeric_value for r in V.calculated_achievements(rows).collect()] == [78.0]


def test_conflict_state(spark):
    stored = spark.createDataFrame([("a", "review_required"), ("b", "confirmed"), ("c", "review_required"), ("d", "dismissed")], "fingerprint string, status string")
    found = spark.createDataFrame([("a",), ("b",), ("e",)], "fingerprint string")
    out = {r.fingerprint: (r.status, r.outcome) for r in V.merge_state(stored, found).collect()}
    assert out == {"a": ("review_required", "refreshed"), "b": ("confirmed", "unchanged_terminal"), "c": ("dismissed", "auto_cleared"), "d": ("dismissed", "kept"), "e": ("review_required", "created")}


def test_open_conflicts_withhold(facts, spark):
    rows = X.normalized(facts(("1", "docA", "production", 5.2, "MT", "Mine B", "FY2024", "approved"), ("2", "docA", "production", 5.0, "MT", "Mine B", "FY2023", "approved"), ("3", "docA", "dispatch", 5.0, "MT", "Mine B", "FY2023", "approved")))
    conflict = lambda period, status: spark.createDataFrame([("mine-b", "output", period, status)], "entity_name string, field_name string, period string, status string")
    ids = lambda c: sorted(r.id for r in X.without_open_conflicts(rows, c).collect())
    assert ids(conflict("FY2024", "review_required")) == ["2", "3"]
    assert ids(conflict("FY2024", "dismissed")) == ["1", "2", "3"]
    assert ids(conflict(None, "confirmed")) == ["3"]


def test_geological_rollups(spark):
    rows = [
        ("1", "seam", "R4", "named", None, "Raniganj Formation", 0.0, "m", 12), ("2", "seam", None, "uncorrelated", None, "Barakar Formation", 0.0, "m", 34), ("3", "resource_quantity", "R4", "named", None, None, 1.67, "MT", 31),
        ("4", "borehole_depth", None, "named", "NP-01", None, 142.6, "m", 20), ("5", "seam_thickness", "R4", "named", None, None, 1.2, "m", 15), ("6", "formation", None, "named", None, "through the Formation", 0.0, "m", 21),
    ]
    schema = "id string, metric_kind string, seam_name string, seam_status string, borehole_id string, geological_formation string, value_num double, length_unit string, source_page int"
    data = spark.createDataFrame(rows, schema).withColumns({"document_id": F.lit("alpha"), "status": F.lit("review_required")})
    rejected = data.where("id = '3'").withColumns({"id": F.lit("9"), "value_num": F.lit(99.9), "status": F.lit("rejected"), "source_page": F.lit(1)})
    t = E.typed(data.unionByName(rejected))
    (r,) = E.resources_by_seam(t).collect()
    assert (r.seam, r.quantity, r.pending) == ("Seam R4", 1.67, True)
    assert {x.formation for x in E.formations(t).collect()} == {"Raniganj Formation", "Barakar Formation"}
    seams = {x.seam: x for x in E.seams(t).collect()}
    assert set(seams) == {"Seam R4", "Uncorrelated coal seam"} and seams["Seam R4"].thickness == 1.2
    assert {x.id for x in E.of_formation(t, "Raniganj").collect()} == {"1", "3", "5", "9"}
    s = {x.document_id: x for x in E.document_summary(t).collect()}["*"]
    assert (s.facts, s.seams, s.boreholes, s.pending) == (6, 1, 1, True)


def test_review(spark, facts):
    rows = facts(*[(str(i), "docA", "production", 1.0, "MT", "Mine B", "FY2024", s) for i, s in enumerate(("review_required", "review_required", "approved"))])
    acts = spark.createDataFrame([("0", "correct", 2.0, "u", 2, 2), ("0", "reject", None, "u", 3, 3), ("1", "approve", None, "u", 1, 1), ("2", "reject", None, "u", 1, 1)], "fact_id string, action string, corrected_value double, reviewer string, acted_at int, seq int")
    out = {r.id: (r.status, r.numeric_value, r.original_value, r.fact_version) for r in W.apply_actions(rows, acts).collect()}
    assert out == {"0": ("corrected", 2.0, 1.0, 2), "1": ("approved", 1.0, 1.0, 1), "2": ("approved", 1.0, 1.0, 1)}
    assert [(r.id, r.original_value, r.corrected_value) for r in W.history(rows, acts).collect()] == [("0", 1.0, 2.0)]
    log = spark.createDataFrame([("1", {"password": "x", "n": "1"}, 1), ("2", {"a": "b"}, 2)], "id string, details map<string,string>, created_at int")
    assert [r.details for r in W.audit(log, 1).collect()] == [{"a": "b"}]


def test_chunks(spark):
    text = "1. Intro\n" + " ".join(f"Sentence number {i} of the first section." for i in range(40)) + "\n2. Next Part\nShort."
    rows = C.chunks(spark.createDataFrame([("d", text), ("e", ""), ("f", "x" * 1200)], "document_id string, text string")).collect()
    d = [r.content for r in sorted(rows, key=lambda r: r.chunk_index) if r.document_id == "d"]
    assert all(len(c) <= C.SIZE + C.OVERLAP + 1 for c in d) and d[-1] == "2. Next Part Short."
    assert d[1].startswith(d[0][-C.OVERLAP :])
    assert not [r for r in rows if r.document_id == "e"] and len([r for r in rows if r.document_id == "f"]) == 3
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_embedding(spark):
    def by_hand(text, dim=C.DIMENSIONS):
        import re

        words = [re.sub("(?:ing|ed|es|s)$", "", w) if len(w) > 4 else w for w in re.findall("[a-z0-9]+", text.lower())]
        grams = words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + [w[i : i + n] for n in (3, 4) for w in words for i in range(len(w) - n + 1)]
        out = {}
        for g in grams:
            rest = int(hashlib.md5(g.encode()).hexdigest(), 16) % (2 * dim)
            out[rest % dim] = out.get(rest % dim, 0) + (1 if rest < dim else -1) * (1 + math.log1p(len(g)))
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {k: x / norm for k, x in out.items() if x}

    text = "What was Mine B production in FY2024?"
    got = {r.idx: r.weight for r in C.embeddings(spark.createDataFrame([("c", text)], "chunk_id string, content string")).collect()}
    assert got == pytest.approx(by_hand(text))


def test_text_facts(spark):
    pages = spark.createDataFrame([("d", 1, "Mine B produced 3.9 MT during FY2024 against a target of 5.0 MT.")], "document_id string, page_number int, text string")
    assert {(r.field, r.value, r.unit, r.period) for r in T.production_facts(pages).collect()} == {("production", 3.9, "MT", "FY2024"), ("production_target", 5.0, "MT", "FY2024")}
    log = spark.createDataFrame([("d", 1, "Borehole BH-27 met Seam III at depth 142.6 m with thickness 3.42 m in Barakar Formation.")], "document_id string, page_number int, text string")
    assert {(r.metric_kind, r.seam_name, r.borehole_id, r.value) for r in C.geological_facts(log).collect()} == {("borehole_depth", "Seam III", "BH-27", 142.6), ("seam_thickness", "Seam III", "BH-27", 3.42)}


def test_table(spark):
    grid = [["Sl No", "Subs", "Monthly Target", "Production during Mar", "–", "–", "–", "Production upto Mar", "–", "–"], ["–", "–", "–", "FY 24", "Achmt.(%)", "FY 25", "Growth", "FY 24", "FY 25", "Growth"], ["1", "Alpha Co", "1.00", "0.90", "90", "1.10", "0", "9.00", "11.00", "0"]]
    cells = spark.createDataFrame([("d", 0, i, j, x) for i, row in enumerate(grid) for j, x in enumerate(row)], "document_id string, table_no int, row_no int, col_no int, text string")
    got = {(r.measure, r.period, r.value, r.month) for r in C.table_facts(cells).collect()}
    assert got == {("during", "FY2024", 0.9, "March"), ("during", "FY2025", 1.1, "March"), ("upto", "FY2024", 9.0, "March"), ("upto", "FY2025", 11.0, "March")}


def test_retrieval(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0]), ("s", [1.0])], "id string, vector array<double>")
    got = [(r.id, r.score) for r in R.exact_top_k(rows.where("id = 'a'"), rows, 3).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 0.6), ("s", 0.0)]
    with pytest.raises(ValueError, match="sparse"):
        R.exact_top_k(rows, rows, 3, most_queries=2)
    hits = rows.selectExpr("id", "'x' as document_id")
    assert R.in_scope(hits, None).count() == 4 and R.in_scope(hits, hits.where("false")).count() == 0
    one = spark.range(1)
    assert one.select(R.names_entity(F.lit("NLCIL grew"), F.lit("CIL"))).first()[0] is False
    assert one.select(R.names_period(F.lit("output in 2023-24"), F.lit("FY2024"))).first()[0] is True


def test_store(spark, tmp_path):
    stored = spark.createDataFrame([("c1", "d1", "old", 1), ("c2", "d2", "stays", 1)], "chunk_id string, document_id string, content string, version int")
    new = spark.createDataFrame([("c3", "d1", "first", 1), ("c3", "d1", "last", 2)], stored.schema)
    out = store.upserted(stored, new)
    assert {(r.chunk_id, r.content) for r in out.collect()} == {("c2", "stays"), ("c3", "last")}
    store.write_buckets(out, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    cells = spark.createDataFrame([("d", "FY2024", i, j, x) for i, row in enumerate([["Mine", "Production", "Target"], ["Mine A", "4.8", "5.0"], ["Mine B", "3.9", "5.0"]]) for j, x in enumerate(row)], "document_id string, sheet_name string, row_no int, col_no int, text string")
    (page,) = store.sheets_to_pages(cells).collect()
    assert page.columns == ["Mine", "Production", "Target"] and page.row_count == 2 and page.text.endswith("Mine B | 3.9 | 5.0")


def test_ingest(spark, tmp_path):
    source, path, marks = (str(tmp_path / n) for n in ("pages", "store", "marks"))
    told = "Mine B produced 3.9 MT during FY2024. Target of 5 MT."
    log = "Borehole No. BH-7 was drilled to a depth of 80 m through sandstone and shale. Coal seam: Seam IV thickness 2.5 m."
    spark.createDataFrame([("d1", "One. Two. " + told, 1), ("d2", "Other.", 1), ("d3", log, 1)], ingest.PAGES).write.parquet(source)
    ingest.ingest(spark, source, path, marks).awaitTermination()
    assert {(r.document_id, r.field) for r in ingest.current(spark, path, "production").collect()} == {("d1", "production"), ("d1", "production_target")}
    assert {(r.document_id, r.domain) for r in ingest.current(spark, path, "documents").collect()} == {("d1", "mining_production"), ("d2", "other"), ("d3", "geological_exploration")}
    depths = ingest.current(spark, path, "geology").where("depth is not null").collect()
    assert [(r.document_id, r.borehole_id, r.depth) for r in depths] == [("d3", "BH-7", "80")]
    spark.createDataFrame([("d1", "Three.", 2)], ingest.PAGES).write.mode("append").parquet(source)
    ingest.ingest(spark, source, path, marks).awaitTermination()
    for at in (path, str(tmp_path / "less")):
        chunks = ingest.current(spark, at).where("document_id <> 'd3'").collect()
        assert {(r.document_id, r.content) for r in chunks} == {("d1", "Three."), ("d2", "Other.")}
        assert ingest.current(spark, at, "production").count() == 0  # the new version tells of none
        ingest.compacted(spark, path, str(tmp_path / "less"))


def test_circles_of_versions_end(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "z"), ("y", "x"), ("z", "y"), ("t", "x"), ("m", "gone")]
    docs = spark.createDataFrame(rows, "document_id string, replaces string")
    from lodestone.sources.cut import ensure_checkpoints

    ensure_checkpoints(spark)
    got = {r.document_id: r.root for r in W.version_roots(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "m": "gone", "x": None, "y": None, "z": None, "t": None}


def test_secrets_at_any_depth(spark):
    from lodestone.functions import normalize as N

    given = ['{"a":1,"Token":"x","b":{"password_hash":"y","c":[{"secret":1}],"d":{"API_KEY":{"e":1}}}}', "{}", "no json", None]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").orderBy("i").select(N.sanitize_json(F.col("t")).alias("d")).collect()]
    assert got == ['{"a":1,"b":{"c":[{"secret":1}],"d":{}}}', None, None, None]


def test_boosts(spark):
    """Question and text against the rules of RET-4, term by term."""
    cases = [
        ("How much coal did Alpha produce in FY2024?", "Alpha coal output", 0.35 * 2 / 4 + 0.28),
        ("How much coal did Alpha produce in FY2024?", "coal of others", 0.35 * 1 / 4 - 0.45),
        ("lignite production of nlcil", "nlc india nlcil lignite production performance: Lignite: target 5", min(0.75, 0.35 * 3 / 4 + 0.24 + 0.28 + 0.18 + 0.12)),
        ("production of sccl", "reconstructed from source table of neyveli production", -0.45 + 0.35 * 1 / 3 - 0.25 - 0.22),
        ("production of sccl", "nothing at all", -0.05),
        ("the of", "anything", 0.0),
    ]
    rows = spark.createDataFrame([(q, t) for q, t, _ in cases], "q string, t string")
    for r, (q, t, want) in zip(rows.select(R.keyword_boost(F.col("q"), F.col("t")).alias("b")).collect(), cases, strict=True):
        assert r.b == pytest.approx(max(-0.55, want)), (q, t)


def test_index_facts(spark):
    meta = ['{"entity":" Alpha ","metric":"Output","fiscal_year":"2023-24","measurement_type":"During","value":"10.5","unit":"MT"}', '{"entity":"Alpha","metric":"coal","value":"n.a."}', '{"entity":"","metric":"coal","value":1}', "not json"]
    chunks = spark.createDataFrame([(str(i), "d", m, True, "structured_fact") for i, m in enumerate(meta)], "chunk_id string, document_id string, meta string, is_active boolean, content_type string")
    (r,) = X.index_facts(chunks).collect()
    assert (r.entity_name, r.metric, r.period, r.measure, r.value, r.confidence) == ("Alpha", "production", "FY2023-24", "during", 10.5, 0.9)


def test_search_of_any_number_of_queries(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(1_300, 4)).round(3)
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in R.exact_top_k(rows, rows, 3, -1.0).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.lexsort((np.broadcast_to(np.arange(1_300), (1_300, 1_300)), -(unit @ unit.T).round(9)))[:, :3]
    assert got == {(q, r + 1): int(i) for q, ids in enumerate(want) for r, i in enumerate(ids)}


def test_sparse_search_asks_a_hundredth(spark):
    from lodestone.plans import catalog

    tables = catalog.Tables(spark, "/root/testdata/sf0.001")
    asked = {r.query_id for r in catalog.QUERIES["sparse_top_k"](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()}
    ids = {r.id for r in tables.fact.select("id").collect()}
    assert asked <= ids and 0.005 * len(ids) < len(asked) < 0.02 * len(ids) and len({i.split("/")[1] for i in asked}) > 10
