"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lodestone.plans import answers, bounded, catalog, layouts, reasons, reports  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name in catalog.SQL:
        found = duck.sql(catalog.SQL[name])
        names = found.columns
        assert sorted(names) == columns
        want = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
        assert sorted([plain(r[c]) for c in columns] for r in rows) == want


def test_whole_views_grow(spark):
    from lodestone.sources.views import view

    for name in ("v_fact", "v_index", "v_document"):
        small, large = (view(spark, f"/root/testdata/{sf}", f"{name}_whole").count() for sf in ("sf0.001", "sf0.01"))
        assert large > 8 * small
