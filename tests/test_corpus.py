"""Classes of documents by their cues."""

from lodestone.functions.cues import DOMAIN_CUES
from lodestone.operators import corpus as C
from lodestone.plans.catalog import QUERIES


def test_domain_classes_tell_their_confidence(spark, tmp_path):
    texts = [(1, "the of and the"), (2, "the of der und und"), (3, "the"), (4, None), (5, "thé_the_ of of")]
    rows = spark.createDataFrame([(i, t, "web") for i, t in texts], "doc_id long, text string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.document_id: (r.domain, r.score, r.confidence) for r in QUERIES["domain_classes"](spark, str(tmp_path)).collect()}
    assert got == {"d1": ("en", 3.5, 0.97), "d2": ("de", 3.0, 0.743), "d3": ("other", 1.0, 0.35), "d4": ("other", 0.0, 0.2), "d5": ("en", 3.0, 0.97)}


def test_pages_are_classified_in_one_pass(spark):
    rows = [("a", "Drilling of BORE\n HOLE 7; drilling-rig", "Borehole.pdf"), ("b", None, None), ("c", "redrilling drillings", "x.pdf"), ("c", "formation", "x.pdf")]
    out = C.classify(spark.createDataFrame(rows, "document_id string, text string, filename string"), DOMAIN_CUES, 2.5, 3.0, "filename")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.document_id, r.domain, r.score, r.confidence) for r in out.collect()) == [("a", "geological_exploration", 9.05, 0.97), ("b", "other", 0.0, 0.2), ("c", "other", 0.0, 0.2), ("c", "other", 1.5, 0.35)]
