"""Every query of the catalogue against its SQL form in DuckDB, over the smallest driver tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ledgerleaf.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        files = [f"{SF}/{t}.parquet"] if os.path.isfile(f"{SF}/{t}.parquet") else glob.glob(f"{SF}/{t}.parquet/*.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v or v is pd.NaT or v is pd.NA:
        return "null"
    if isinstance(v, float):
        return f"{v:.7g}"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, want.df().astype(object).itertuples(index=False, name=None))


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, capsys):
    catalog.QUERIES["guard_rail_rule"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(n_chars), LessThan(n_chars,300)" in plan
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan


def test_a_broken_subpackage_is_no_missing_one(monkeypatch):
    """Only a folder that is not there leaves queries out; an error inside it is raised."""
    import builtins
    import importlib.util

    import __spark_entry__

    if importlib.util.find_spec("ledgerleaf.llm") is None:
        assert not [n for n in __spark_entry__.queries() if n.startswith("op")]
        return
    real = builtins.__import__

    def broken(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "ledgerleaf.llm" and "queries" in (fromlist or ()):
            raise ImportError("a library is missing")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ImportError):
        __spark_entry__.queries()
