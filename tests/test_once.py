"""Names are read once for each row, whatever filters and projections stand above."""

from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.operators import analytics as A
from lodestone.operators import facts as X
from lodestone.operators import geology as E

CHUNK = "chunk_id string, document_id string, meta string, is_active boolean, content_type string"
FACT = "id string, document_id string, entity_name string, field_name string, financial_year string, numeric_value double, unit string, status string, is_calculated boolean, confidence_score double"


def test_filters_do_not_copy_the_reading_of_names(spark):
    meta = '{"entity": " Mine A ", "metric": "Annual  Production", "fiscal_year": "2023-2024", "measurement_type": " Actual", "value": "5.2", "unit": "MT"}'
    chunks = spark.createDataFrame([("c1", "d1", meta, True, "structured_fact")], CHUNK)
    facts = spark.createDataFrame([("f1", "d1", "Mine A", "Target", "FY 2024", 6.0, "MT", "approved", False, 0.9)], FACT)
    rows = X.classified(X.index_facts(chunks), facts).where("storage_metric in ('production', 'production_target') and metric = 'production' and period <> ''")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("[\\s\\-_]+") <= 3  # of the index, of its rows, of the facts
    said = {(r.metric, r.measure, r.storage_metric, r.period, r.value) for r in rows.collect()}
    assert said == {("production", "during", "production", "FY2023-24", 5.2), ("production", "target", "production_target", "FY2024", 6.0)}


def test_periods_and_fields_by_one_pattern_each(spark):
    row = spark.range(1).select(*(N.period(F.lit(x)).alias(f"p{i}") for i, x in enumerate(("FY2024", " 2023-2024 ", "fy 2023–24", "2024-2", "202425", "Q1 2024", "", " "))), *(N.field(F.lit(x)).alias(f"f{i}") for i, x in enumerate((" Ore -_ Grade ", "a - b__c", ""))))
    assert list(row.first()) == ["FY2024", "FY2023-24", "FY2023-24", "2024-2", "202425", "q12024", None, "", "grade", "a_b_c", None]


def test_filters_do_not_copy_the_reading_of_geological_names(spark):
    schema = "id string, document_id string, metric_kind string, seam_name string, seam_status string, geological_formation string, borehole_id string, value_num double, length_unit string, source_page int, status string"
    base = ("resources", "seam R4", "named", "the Barakar Formation", "BH-1", 250.0, "cm", 1, "approved")
    rows = spark.createDataFrame([("a", "d", *base), ("b", "d", *base[:3], "through the Formation", *base[4:]), ("c", "d", None, None, None, None, None, None, None, None, None)], schema)
    typed = E.typed(rows)
    kept = typed.where("formation <> 'x' and seam is not null and kind <> ''")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)^seam\\s+") == 1 and plan.count("([A-Za-z]+)") == 1
    assert [(r.id, r.kind, r.seam, r.formation, r.borehole_key, r.metres) for r in kept.collect()] == [("a", "resource_quantity", "Seam R4", "Barakar Formation", "bh1", 2.5)]
    assert {r.id: r.formation for r in typed.collect()} == {"a": "Barakar Formation", "b": None, "c": None}


def counted(spark, df, column):
    """The rows with a column that counts how often it is read, and the counter."""
    read = spark.sparkContext.accumulator(0)

    @F.udf(df.schema[column].dataType)
    def seen(value):
        read.add(1)
        return value

    return df.withColumn(column, seen.asNondeterministic()(column)), read


def test_merged_pairs_read_index_facts_once(spark):
    base = ("index", "P", "MT", 0.9)
    rows = [(*base, "A", "coal", "during", 4.0, "a1"), (*base, "A", "coal", "target", 5.0, "a2"), (*base, "A", "production", "during", 1.0, "a3"), (*base, "A", "lignite", "during", 7.0, "a4"), (*base, "A", "lignite", "target", 8.0, "a5"), (*base, "B", "coal", "during", 2.0, "b1")]
    index = spark.createDataFrame(rows, "source string, period string, unit string, confidence double, entity_name string, storage_metric string, measure string, value double, fact_id string")
    named = [(e, f, "P", v, v, "MT", 0.9, f"{e}/{f}") for e in ("a", "b") for f, v in (("production", 3.0), ("production_target", 6.0))]
    facts = spark.createDataFrame(named, "entity string, field string, period string, numeric_value double, base_value double, unit string, confidence_score double, id string")
    index, read = counted(spark, index, "value")
    got = {(r.entity, r.actual, r.target, r.actual_id, r.path, r.achievement) for r in A.actual_vs_target_merged(index, facts).collect()}
    assert got == {("a", 4.0, 5.0, "a1", "index", 80.0), ("b", 3.0, 6.0, "b/production", "fields", 50.0)}
    assert read.value == len(rows)


def test_parts_of_the_explorer_read_rows_once(spark):
    schema = "id string, document_id string, metric_kind string, seam_name string, seam_status string, geological_formation string, borehole_id string, value_num double, length_unit string, source_page int, status string"
    kinds = ("resources", "borehole_depth", "seam_thickness", "formation")
    rows = [(f"f{n}", f"d{n % 2}", kinds[n % 4], "R4", "named", "Barakar Formation", f"BH-{n}", 2.0, "m", n, "rejected" if n == 7 else "approved") for n in range(8)]
    base, read = counted(spark, spark.createDataFrame(rows, schema), "seam_name")
    parts = E.explorer_overview(E.typed(base), spark.createDataFrame([("d0", "x.pdf")], "document_id string, filename string"))
    got = {r.part: r.n for r in E.overview_counts(parts).collect()}
    assert got == {"facts": 7, "filters": 15, "summary": 3, "formations": 1, "seams": 2, "boreholes": 7, "tree": 1, "resources": 1, "depths": 2, "thickness": 1}
    assert {(r.fact_id, r.entity) for r in parts["facts"].collect()} == {(f"f{n}", "x.pdf" if n % 2 == 0 else "d1") for n in range(7)}
    assert read.value == len(rows)
