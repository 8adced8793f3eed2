"""Geological facts from pages that tell several things each."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import strata as S

PAGES = [
    ("a", 1, "Borehole No. CMBJ-12 was drilled to a depth of 142.60 m. Seam III Top was met; thickness 3.42 m of coal. A fault lies near. Ash content of 21.5 % was found."),
    ("b", 2, "The general thickness of the seam R4 varies from 1.20 m to 3.50 m within the block. The parting is thin."),
    ("c", 3, "An uncorrelated coal seam of the Barakar Formation was met. The minimum workable thickness considered is 0.90 m. Average thickness of the Raniganj Formation is 120-340 m."),
    ("d", 4, "Total coal resources of Seam L1 are 14.25 MT. Proved reserves stand at 3.5 million tonnes. The Talchir Formation and the Talchir Formation again."),
    ("e", 5, None),
    ("f", 6, "Nothing of the kind."),
    ("g", 7, "Seam II thickness 2.0 m." + " filler" * 100 + " Borehole BH-7 depth 80 m."),
]


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, text string")
    out = {}
    for r in S.scored(S.drafts(pages)).collect():
        out.setdefault(r.document_id, []).append(r)
    return out


def pick(rows, **want):
    return [r for r in rows if all(r[k] == v for k, v in want.items())]


def test_places(spark):
    text = "ab Seam III, xx seam R4; Seam V"
    got = spark.range(1).select(S.matches(F.lit(text), S.SEAM_NAMED).alias("m")).first().m
    assert [(text[m.start : m.end], m.g1) for m in got] == [("Seam III", "III"), ("seam R4", "R4"), ("Seam V", "V")]
    assert spark.range(1).select(S.matches(F.lit("none"), S.SEAM_NAMED).alias("m")).first().m == []


def test_anchors(rows):
    hole, seam = pick(rows["a"], borehole_id="CMBJ-12", metric_kind="borehole_depth") or pick(rows["a"], borehole_id="CMBJ-12"), pick(rows["a"], seam_name="Seam III Top")
    assert hole[0].depth == "142.60" and hole[0].depth_normalized_m == 142.6 and hole[0].thickness == "3.42"  # the first anchor near a measure has it
    assert hole[0].seam_name == "Seam III Top" and hole[0].geological_structure == "fault" and hole[0].coal_quality_parameter == "Ash" and hole[0].coal_quality_value == "21.5"
    assert all(r.thickness is None for r in seam if r.borehole_id is None)
    assert all(0 <= r.extraction_confidence <= 0.95 for r in rows["a"])


def test_nearest(rows):
    seam, hole = pick(rows["g"], seam_name="Seam II")[0], pick(rows["g"], borehole_id="BH-7")[0]
    assert (seam.thickness, seam.borehole_id, hole.depth, hole.seam_name) == ("2.0", None, "80", None)  # too far from each other


def test_ranges(rows):
    found = pick(rows["b"], thickness_min="1.20")
    assert len(found) == 1 and found[0].thickness_max == "3.50" and found[0].seam_name == "Seam R4" and found[0].qualifier == "range" and found[0].thickness_normalized_m == 1.2
    assert found[0].borehole_id is None and found[0].status in ("high_confidence", "review_required")
    assert pick(rows["c"], metric_kind="formation_thickness")[0].geological_formation == "Raniganj Formation"
    assert (pick(rows["c"], metric_kind="formation_thickness")[0].thickness_min, pick(rows["c"], metric_kind="formation_thickness")[0].thickness_max) == ("120", "340")


def test_unnamed_and_workable(rows):
    seam = pick(rows["c"], metric_kind="seam")[0]
    assert (seam.seam_name, seam.seam_status, seam.geological_formation, seam.status) == (None, "uncorrelated", "Barakar Formation", "review_required")
    work = pick(rows["c"], metric_kind="minimum_workable_seam_thickness")[0]
    assert (work.thickness, work.thickness_unit, work.seam_name) == ("0.90", "m", None)
    # base, one field, workable, evidence, page
    assert work.extraction_confidence == pytest.approx(0.4 + 0.07 + 0.1 + 0.1 + 0.05)


def test_quantities_and_formations(rows):
    assert [(r.original_value, r.seam_name) for r in pick(rows["d"], metric_kind="resource_quantity")] == [("14.25", "Seam L1")]
    assert len(pick(rows["d"], metric_kind="reserve_quantity")) == 1
    assert len(pick(rows["d"], metric_kind="formation")) == 1
    assert "e" not in rows and "f" not in rows
