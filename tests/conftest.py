from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def connected(folder):
    """DuckDB with the tables of a folder as views."""
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def comparer(folder):
    """Compare a Spark result with SQL over the tables of a folder, row by row, whatever the order; doubles up to the last rounded digit.

    Each comparison has a connection of its own: a fault of one can't spoil the others.
    """

    def check(df, sql):
        want = connected(folder).sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        rows = [[r[c] for c in columns] for r in df.collect()], [[r[want.columns.index(c)] for c in columns] for r in want.fetchall()]
        got, expected = (sorted(x, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), [v for v in r if isinstance(v, float)])) for x in rows)
        assert len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            assert a == [pytest.approx(v, abs=1.1e-4 if abs(v) > 1000 else 1.1e-6) if isinstance(v, float) else v for v in b]

    return check


@pytest.fixture(scope="session")
def same_rows(sf_dir):
    return comparer(sf_dir)


@pytest.fixture(scope="session")
def more_rows():
    """The next larger tables, and their comparison."""
    folder = "/root/testdata/sf0.01"
    return folder, comparer(folder)
