import pytest
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import normalize as N


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(column):
        out = one.select(column.alias("x")).first()["x"]
        return out.asDict() if hasattr(out, "asDict") else out

    return get


L = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(x)


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (N.field, "Annual Production", "production"), (N.field, "Production Target", "production_target"), (N.field, " Odd-Name  x", "odd_name_x"), (N.field, "", None), (N.field, None, None),
        (N.entity, "Mine-B", "mine b"), (N.entity, "A & B/C", "a and b c"), (N.entity, "..", None),
        (N.period, "FY2024", "FY2024"), (N.period, "2023-2024", "FY2023-24"), (N.period, "FY 2023–24", "FY2023-24"), (N.period, "March", "march"), (N.period, "", None),
        (N.measure, "Actual", "during"), (N.measure, "up to", "upto"), (N.measure, "revised", "target"), (N.commodity, "Coking Coal", "coking_coal"), (N.commodity, "steel", None),
        (N.plausible_entity, "Alpha Co", True), (N.plausible_entity, "%x", False), (N.plausible_entity, "1.2", False), (N.plausible_entity, "Sub-Total", False), (N.plausible_entity, None, False),
        (N.reporting_month, "Production during Mar", "March"), (N.reporting_month, "Mar' 2025", "March"), (N.reporting_month, "Dec'24", "December"), (N.reporting_month, "nothing", None),
        (N.header_year, "FY 25", "FY2025"), (N.header_year, "FY2024", "FY2024"), (N.header_year, "Mar 2025", "FY2025"), (N.header_year, "Growth", None),
        (N.number, "1,142.55 t", 1142.55), (N.number, "n.a.", None), (N.number, "12", 12.0), (N.family_key, "Alpha_Geo (v2).pdf", "alpha geo v2"), (N.slug, "Coal & Lignite", "coal-lignite"),
        (G.seam, "Seam R4", "Seam R4"), (G.seam, "R4 seam", "Seam R4"), (G.seam, "Seam III Top", "Seam III Top"), (G.seam, "III b", "Seam III Bottom"), (G.seam, "coal seam", None), (G.seam, "seam found", None), (G.seam, "seam wise", None),
        (G.borehole_key, "NP-01", "np01"), (G.formation, "the barakar formation", "Barakar Formation"), (G.formation_is_plausible, "Raniganj Formation", True), (G.formation_is_plausible, "through the Formation", False), (G.formation_is_plausible, None, False),
        (G.formation_is_plausible, "Main Formation", False), (G.formation_is_plausible, "Regional Formation", False), (G.formation_is_plausible, "Observed Formation", False), (G.formation_is_plausible, "Upper Barakar Formation", True),
        (G.metric_kind, "workable thickness", "minimum_workable_seam_thickness"), (G.metric_kind, "resources", "resource_quantity"), (G.qualifier, "1.2 - 3.4 m", "range"),
    ],
)
def test_scalar(value, f, given, want):
    assert value(f(L(given))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("Mine B", "mine-b", "exact"), ("Mine B", "Mine B Complex", "ambiguous"), ("Mine A", "Mine B", "different"), ("CIL", "NLCIL", "different"), ("", "x", "missing"), ("North Pit Area One", "North Pit Area Two", "ambiguous")])
def test_entity_match(value, a, b, want):
    assert value(N.entity_match(L(a), L(b))) == want


def test_soft_match(value):
    assert value(N.soft_match(L("CIL"), L("NLCIL"))) is False
    assert value(N.soft_match(L("Coal India"), L("coal india limited"))) is True
    assert value(N.soft_match(L("CIL"), L("Coal India"), {"cil": "coal india"})) is True


def test_units(value):
    mt, odd, pct = (N.unit(L(u)) for u in ("MT", "bananas", "%"))
    assert value(N.base_value(F.lit(3.9), mt)) == pytest.approx(3_900_000)
    assert value(odd)["review"] is True and value(odd)["canonical"] == "bananas"
    assert value(N.unit(L(None)))["canonical"] == "unknown"
    assert value(N.compare(F.lit(5.2), mt, F.lit(5.2), pct))["unit_review"] is True
    assert value(N.compare(F.lit(5.20), mt, F.lit(5.2), mt))["equal"] is True
    assert value(N.compare(F.lit(5.2), mt, F.lit(5.3), mt))["conflict"] is True
    assert value(N.compare(F.lit(None).cast("double"), mt, F.lit(5.3), mt))["diff"] is None


def test_metrics(value):
    assert value(N.classify_metric(L("coal"))) == {"commodity": "coal", "metric": "production", "measure": "during", "storage_metric": "coal"}
    assert value(N.classify_metric(L("target")))["measure"] == "target"
    assert value(N.storage_metrics(L("coal"), L("production"), L(None))) == ["coal", "production"]
    assert value(N.storage_metrics(L(None), L("production"), L("target"))) == ["production_target", "production"]
    assert value(N.storage_metrics(L(None), L("coal"), L(None))) == ["coal"]
    assert value(N.percentage_change(F.lit(1.0), F.lit(0.0))) == {"value": None, "undefined": True}
    assert value(N.absolute_change(F.lit(85.81), F.lit(88.58))) == pytest.approx(-2.77)
    assert value(N.same_unit(L("MT"), L("mt"))) is True and value(N.same_unit(L("MT"), L("MU"))) is False


def test_geology(value):
    assert value(G.to_metres(F.lit(10.0), L("ft"))) == pytest.approx(3.048)
    assert value(G.to_tonnes(F.lit(1.67), L("MT"))) == pytest.approx(1_670_000)
    assert value(G.metrics_compatible(L("seam_thickness"), L("minimum_workable_seam_thickness"))) is False
    assert value(G.metrics_compatible(L("seam"), L("resource_quantity"))) is True
    assert value(G.metrics_compatible(L("seam_thickness"), L(None))) is False
    assert value(G.latitude_longitude(L("Latitude: 23.5, Longitude: 87.1"))) == {"latitude": 23.5, "longitude": 87.1}
    assert value(G.latitude_longitude(L("23.5° S, 87.1° W"))) == {"latitude": -23.5, "longitude": -87.1}
    assert value(G.latitude_longitude(L("Latitude: 123.5, Longitude: 87.1"))) is None
    assert value(G.latitude_longitude(L("23.5, 87.1"))) is None
    assert value(G.seam_label(L(None), L("uncorrelated"))) == "Uncorrelated coal seam"
    assert value(G.resource(L("resource_quantity"), L(None), L(None), L("1.67"), L("MT"), L(None)))["tonnes"] == pytest.approx(1_670_000)
    assert value(G.resource(L("seam"), L(None), L(None), L(None), L(None), L("resources of 2.5 MT proved")))["value"] == "2.5"


def test_display_values(spark):
    """One row for each step of the order."""
    names = ("kind", "corrected_value", "original_value", "original_unit", "thickness", "thickness_min", "thickness_max", "thickness_unit", "depth", "depth_unit", "quality_value", "seam", "borehole", "evidence")
    cases = [
        ({"kind": "seam_thickness", "corrected_value": "2.5", "original_unit": "m", "thickness": "3"}, ("2.5", "m", None)),
        ({"kind": "resource_quantity", "original_value": "14.25", "original_unit": "MT"}, ("14.25", "MT", 14.25)),
        ({"kind": "resource_quantity", "evidence": "Total resource 3.5 million tonnes"}, ("3.5", "MT", 3.5)),
        ({"kind": "seam_thickness", "thickness": "1.2–3.5", "thickness_min": "1.2", "thickness_max": "3.5", "thickness_unit": "m"}, ("1.2–3.5", "m", 1.2)),
        ({"kind": "seam_thickness", "thickness": "120", "thickness_unit": "cm"}, ("120", "cm", 1.2)),
        ({"kind": "minimum_workable_seam_thickness", "evidence": "minimum workable thickness considered is 0.9 m"}, ("0.9", "m", 0.9)),
        ({"kind": "borehole_depth", "depth": "80", "depth_unit": "m"}, ("80", "m", 80.0)),
        ({"kind": "coal_quality", "quality_value": "21.5"}, ("21.5", None, None)),
        ({"kind": "seam", "seam": "Seam L1", "borehole": "BH-7"}, ("Seam L1", None, None)),
        ({"kind": None, "borehole": "BH-7"}, ("BH-7", None, None)),
        ({"kind": "lithology"}, None),
    ]
    rows = spark.createDataFrame([(i, *(c.get(n) for n in names)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in names))
    got = rows.orderBy("i").select(G.display_value({n: F.col(n) for n in names}).alias("d")).collect()
    for r, (case, want) in zip(got, cases, strict=True):
        assert (r.d and (r.d.value, r.d.unit, r.d.numeric and round(r.d.numeric, 9))) == want, case
