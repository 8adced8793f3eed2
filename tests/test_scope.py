"""Document scopes: the four routes, isolation of the selected report, empty against open scopes."""

from __future__ import annotations

import pytest

from lodestone.operators import scope as S

DOCUMENTS = [("k1", "Korea_Block_Report.pdf", 1, 1), ("k2", "korea block report.PDF", 2, 2), ("s1", "Singrauli_Exploration.pdf", 1, 3), ("t1", "Talcher_Report.pdf", 1, 4), ("n1", None, 1, 5), ("n2", "...", None, None)]
ASK = "spec_id int, entity string, entities array<string>, selected_id string, session_id string, geological boolean, cross boolean, deictic boolean, names_place boolean"
CASES = [
    # compared documents, with all copies; the first name's newest copy leads
    ((1, None, ["Korea Block", "Talcher"], "s1", None, True, True, False, True), "cross_document_comparison", "cross_document_comparison", "k2", {"k1", "k2", "t1"}),
    # this report, and none selected: nothing
    ((2, "Korea Block", None, None, " ", True, False, True, False), "single_document", "deictic_missing_current_document", None, set()),
    # the selected one alone, without its copies
    ((3, None, None, "k1", "s1", True, False, True, False), "single_document", "current_document_deictic", "k1", {"k1"}),
    ((4, None, None, None, "s1", True, False, False, False), "single_document", "current_document_geological_default", "s1", {"s1"}),
    # another place is named: its report in place of the selected one
    ((5, "Singrauli", None, "k1", None, True, False, False, True), "single_document", "entity_other_document", "s1", {"s1"}),
    # the place is a copy of the selected one, no place is named, or this report is said: the selected one
    ((6, "Korea Block", None, "k2", None, True, False, False, True), "single_document", "current_document_geological_default", "k2", {"k2"}),
    ((7, "Singrauli", None, "k1", None, True, False, False, False), "single_document", "current_document_geological_default", "k1", {"k1"}),
    ((8, "Singrauli", None, "k1", None, True, False, True, True), "single_document", "current_document_deictic", "k1", {"k1"}),
    # a name without a selected document, or where the spec is not geological
    ((9, "Korea Block", None, None, None, False, None, None, None), "single_document", "entity_resolved", "k2", {"k1", "k2"}),
    ((10, "report", None, "s1", None, False, False, False, True), "multi_document", "entity_resolved", "t1", {"k1", "k2", "t1"}),
    # nothing resolves
    ((11, "Nowhere", [], None, None, True, False, False, True), "multi_document", "unscoped", None, None),
    ((12, None, None, None, None, None, None, None, None), "multi_document", "unscoped", None, None),
    ((13, None, ["Nowhere", None], None, None, True, True, False, True), "cross_document_comparison", "cross_document_comparison", None, set()),
    # a selected document that isn't there keeps all others out
    ((14, None, None, "gone", None, True, False, False, False), "single_document", "current_document_geological_default", "gone", {"gone"}),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCUMENTS, "document_id string, filename string, version int, created_at int")


def test_routes(spark, documents):
    scope, allowed = S.scopes(spark.createDataFrame([c[0] for c in CASES], ASK), documents)
    got = {r["spec_id"]: r for r in scope.collect()}
    rows = [(r["spec_id"], r["document_id"]) for r in allowed.collect()]
    assert len(got) == len(CASES) and len(rows) == len(set(rows))
    for ask, mode, reason, primary, documents_ in CASES:
        r = got[ask[0]]
        assert (r["mode"], r["reason"], r["primary_id"], r["open"]) == (mode, reason, primary, documents_ is None), (ask, r)
        assert {d for s, d in rows if s == ask[0]} == (documents_ or set()), ask


def test_hits_stay_in_their_scope(spark, documents):
    asks = spark.createDataFrame([c[0] for c in CASES], ASK)
    scope, allowed = S.scopes(asks, documents)
    hits = asks.select("spec_id").crossJoin(documents.select("document_id", "filename"))
    got = {}
    for r in S.in_scopes(hits.selectExpr("*", "1 as open", "2 as reason"), scope, allowed).collect():
        got.setdefault(r["spec_id"], set()).add(r["document_id"])
    every = {d[0] for d in DOCUMENTS}
    assert got == {k: v for k, v in ((c[0][0], every if c[4] is None else c[4] & every) for c in CASES) if v}


def test_empty_tables_and_copies(spark, documents):
    asks = spark.createDataFrame([CASES[0][0], CASES[11][0]], ASK)
    scope, allowed = S.scopes(asks, documents.where("false"))
    assert {r["spec_id"]: r["open"] for r in scope.collect()} == {1: False, 12: True} and allowed.count() == 0
    scope, allowed = S.scopes(asks.where("false"), documents)
    assert scope.count() == allowed.count() == 0
    hits = spark.createDataFrame([(1, "a", "R.pdf", 1, "Seam  I.", 2.0, 0.5), (1, "b", "r.PDF", 1, "seam i", 2.0, 0.9), (1, "c", "r.pdf", 1, "seam i", 3.0, 0.1), (2, "a", "R.pdf", 1, None, None, None), (2, "b", "R.pdf", 1, "", None, None)], "spec_id int, id string, filename string, page int, text string, value double, score double")
    assert sorted((r["spec_id"], r["id"]) for r in S.without_copies_of_pages(hits).collect()) == [(1, "b"), (1, "c"), (2, "a")]
