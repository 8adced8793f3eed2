"""Steps of the larger queries do their work once: facts that no slot asks for aren't grouped, periods are spelled for slots and not for pairs, facts are read once, and sorts compare numbers."""

from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.operators import analytics as A
from lodestone.operators import answers as B
from lodestone.operators import corpus as C
from lodestone.operators import facts as X
from lodestone.operators import reason as Q

FACT = "fact_id string, entity_name string, metric string, reporting_month string, period string, measure string, value double, unit string, table_title string, page int"
SPEC = "spec_id long, entities array<string>, metrics array<string>, months array<string>, periods array<string>, measures array<string>, mode string"
ROW = "entity_name string, storage_metric string, period string, measure string, reporting_month string, unit string, value double, document_id string, fact_id string, source string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bars_read_asked_names_once_each(spark):
    df = spark.createDataFrame([("Mine-1", "coal", "P", "during", None, "t", 1.0, "d", "1", "index")], ROW).withColumn("confidence", F.lit(0.9))
    conflicts = spark.createDataFrame([], "entity_name string, field_name string, period string, status string")
    bars = B.entity_bars(df, conflicts, spark.createDataFrame([("Mine-1",), ("mine 1",), ("Mine 2",), (None,)], "entity_name string"), "coal")
    assert "Aggregate [entity_name" in plan(bars)
    assert {(r.entity, r.status, r.fact_id) for r in bars.collect()} == {("mine 1", "ok", "1"), ("mine 2", "missing", None)}


def test_slots_group_what_fills_them_and_spell_periods_once(spark):
    of = lambda i, e, k, p, v: (i, e, "coal", "March", p, k, v, "MT", None, 1)
    facts = [of("a", "Mine 1", "during", "FY2023-24", 1.0), of("b", "mine 1 ", "during", "FY 2023-24", 1.0), of("c", "Mine 1", "upto", "FY2023-24", 9.0), of("d", "Mine 2", "during", "FY2023-24", 8.0), of("e", "Mine 1", "during", "q1", 3.0), of("f", "Mine 1", "during", "FY2020-21", 5.0)]
    specs = spark.createDataFrame([(1, ["Mine 1"], ["coal"], None, ["2023-2024", "Q1", "FY1999"], None, None), (2, ["Mine 1"], ["coal"], None, None, None, None)], SPEC)
    rows = Q.candidates(specs, spark.createDataFrame(facts, FACT))
    assert "LeftSemi" in plan(rows)
    conditions = [line for line in plan(rows).splitlines() if "Join " in line and "f_period" in line]  # of slots and facts
    assert len(conditions) == 2 and not any("lambda" in line or "regexp" in line for line in conditions)
    assert "spelled" not in rows.columns
    got = {(r.spec_id, r.slot, r.best and r.best.fact_id, r.n) for r in rows.collect()}
    assert got == {(1, 0, "a", 2), (1, 1, "e", 1), (1, 2, None, None), (2, 0, "a", 2), (2, 0, "e", 1), (2, 0, "f", 1)}


def test_disagreements_read_facts_once(spark):
    of = lambda i, v, unit="MT": (i, "A", "coal", None, "P", "during", v, unit, None, 1)
    facts = [of(f"f{k}", float(k % 4)) for k in range(8)] + [of("x", 2.0, None), of("y", 2.0000001, None), of("z", float("nan")), of("n", None)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        read.add(1)
        return value

    rows = spark.createDataFrame(facts, FACT).withColumn("value", seen.asNondeterministic()("value"))
    (r,) = Q.disagreements(rows, most=3).collect()
    assert (r.entity_name, r.reporting_month, r.unit, r.n_values) == ("A", None, "MT", 4)
    assert [(e.place, e.value, e.fact_id, e.n_facts) for e in r.evidence] == [(1, 0.0, "f0", 2), (2, 1.0, "f1", 2), (3, 2.0, "f2", 2)]
    assert read.value == len(facts)


def test_groups_made_by_sorting_stand_under_a_hash(spark):
    rows = [("A", "coal", "P", None, None, "t", 1.0, "d2", "1", "index"), ("a", "coal", "P", "", None, "t", 1.0, "d1", "2", "extracted"), ("A", "coal", "P", None, None, "t", 3.0, "d1", "3", "index"), ("A", "coal", None, None, None, "t", -0.0, "d1", "4", "index"), ("A", "coal", None, None, None, "t", 0.0, "d1", "5", "index")]
    df = spark.createDataFrame(rows, ROW)
    unique, merged = A.unique_facts(df), X.merged(df)
    assert "xxhash64" in plan(unique) and "xxhash64" in plan(merged)
    assert not {X.HASH, "_n"} & {*unique.columns, *merged.columns}
    assert {(r.entity_name, r.period, r.measure, r.n, r.fact_id, r.conflict) for r in unique.collect()} == {("A", "P", None, 2, "3", True), ("a", "P", "", 1, "2", False), ("A", None, None, 2, "4", False)}
    assert {r.fact_id for r in merged.collect()} == {"1", "3", "4"}


def test_usual_periods_take_one_pattern(spark):
    said = {"FY2024": "FY2024", "2024": "FY2024", "1998-99": "FY1998-99", "fy1998-99": "FY1998-99", "FY 1998-1999": "FY1998-99", "1998–99": "FY1998-99", "FY2024X": "fy2024x", "20245": "20245", "1998-9": "1998-9", "FY2024\n": "FY2024"}
    row = spark.range(1).select(*(N.period(F.lit(x)).alias(f"p{i}") for i, x in enumerate(said)), *(N.period_of(F.lit(x)).alias(f"k{i}") for i, x in enumerate(("FY2024\n", "1998-99\r\n")))).first()
    assert list(row) == [*said.values(), "FY2024", "FY1998-99"]
    names = {"Mine 7": True, "%x": False, "(x": False, "1, 2-3": False, "M": False, "te": False, "12 a": True, " 1/2": False}
    rows = spark.createDataFrame([(x,) for x in names] + [(None,)], "x string")
    assert {r.x: r.p for r in rows.select("x", N.plausible(F.col("x")).alias("p")).collect()} == names | {None: False}
    text = plan(rows.select(N.period_of(F.col("x")).alias("p"), N.plausible(F.col("x")).alias("q")))
    assert text.index("\\z") < text.index("REGEXP_REPLACE" if "REGEXP_REPLACE" in text else "regexp_replace")
    assert text.count("rlike(") + text.count("RLIKE(") == 3


def test_chunks_are_shuffled_once_before_their_texts(spark):
    schema = "document_id string, entity string, metric string, reporting_month string, measurement_type string, fiscal_year string, value double, unit string, page int, table_id string, table_title string, column_path string"
    row = lambda d, unit, page, month=None: (d, "A", "coal", month, "during", "FY24", 1.0, unit, page, "t1", "", "FY24")
    facts = spark.createDataFrame([row("d", "t", 1), row("d", "MT", 1), row("d", "MT", 1), row("d", "MT", 2), row(None, "t", None), row("", "t", None), row("d", "kt", 1, "May"), row("e", "t", 1, "May"), row("e", "t", 1, "")], schema)
    documents = spark.createDataFrame([("d", "x.pdf", 3)], "document_id string, filename string, version int")
    out = C.structured_chunks(facts, documents)
    text = plan(out)
    assert text.count("RepartitionByExpression") == 1 and text.index("STRUCTURED_FACT") < text.index("RepartitionByExpression")
    got = sorted((r.document_id or "", r.document_name or "", r.document_version, r.page_number or 0, r.chunk_index, r.content.split(" | ")[3][17:], r.content.split(" | ")[7], r.token_count) for r in out.collect())
    assert got == [("", "", 1, 0, 0, "Unknown", "unit=t", 21), ("d", "x.pdf", 3, 1, 0, "May", "unit=kt", 21), ("d", "x.pdf", 3, 1, 1, "Unknown", "unit=MT", 21), ("d", "x.pdf", 3, 2, 0, "Unknown", "unit=MT", 21), ("e", "e", 1, 1, 0, "", "unit=t", 21), ("e", "e", 1, 1, 1, "May", "unit=t", 21)]
