"""Every query against its SQL on the smallest test tables; any such folder will do."""

from __future__ import annotations

import os

import duckdb
import pytest

from folioscope import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows: list[tuple]) -> list[str]:
    return sorted(str(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(session, name: str) -> None:
    got = catalog.QUERIES[name](session, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert plain([tuple(r) for r in got.select(*columns).collect()]) == plain(rows)


def test_entry_points_import() -> None:
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
