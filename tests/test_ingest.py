"""The store of an incremental ingest equals one that is built at once, however its batches come."""

from lodestone.streaming import ingest

PAGES = [
    ("d1", "Mine B produced 3.9 MT during FY2024. Target of 5 MT.", 1),
    ("d2", "Mine B produced 4.9 MT during FY2024. Nothing else.", 1),
    ("d3", "Mine B produced 3.9 MT during FY2024. Ore grade: 12 %.", 1),
    ("d4", "Mine C produced 7 MT during FY2023. The rest was moved.", 1),
    ("d2", "Mine C produced 8 MT during FY2023. Corrected sheet.", 2),
    ("d1", "Mine B produced 3.9 MT during FY2024. Target of 6 MT.", 2),
    ("d5", "Mine C produced 7 kt during FY2023.", 1),
    ("d6", "", 1),
    ("d4", "Withdrawn.", 3),
]
#: Newer versions first, rows repeated; the batch in the middle comes twice.
BATCHES = [[5, 8, 0, 0], [4, 7, 1, 6], [3, 2]]


def store(spark, path, batches, retried=()):
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([PAGES[i] for i in batch], ingest.PAGES)
        ingest.apply_batch(rows, n, path)
        if n in retried:
            ingest.apply_batch(rows, n, path)
    return path


def contents(spark, path):
    rows = lambda df: sorted(map(repr, df.drop("batch").collect()))
    found = {part: rows(ingest.current(spark, path, part)) for part in ingest.PARTS}
    return found | {"conflicts": rows(ingest.current_conflicts(spark, path))}


def test_batches_equal_a_rebuild(spark, tmp_path):
    whole = store(spark, str(tmp_path / "whole"), [range(len(PAGES))])
    path = store(spark, str(tmp_path / "store"), BATCHES, retried=(1,))
    rebuilt = contents(spark, whole)
    assert contents(spark, path) == rebuilt
    found = ingest.current_conflicts(spark, path).collect()
    assert {(r.entity, r.field, r.period) for r in found} == {("mine c", "production", "FY2023")} and len(found) == 1  # d2 and d5; what d2 and d4 said before counts no more
    rows = ingest.current(spark, path, "production").collect()
    assert {(r.document_id, r.fact_id) for r in ingest.current(spark, path, "reviews").collect()} == {(r.document_id, r.fact_id) for r in rows if r.status == "review_required"}
    chunks = {r.chunk_id for r in ingest.current(spark, path, "chunks").collect()}
    vectors = {r.chunk_id for r in ingest.current(spark, path, "vectors").collect()}
    assert vectors and vectors <= chunks
