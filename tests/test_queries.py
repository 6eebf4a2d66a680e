"""Every query with SQL gives what the SQL gives."""

import math

import duckdb
import pytest

from lorespark.plans import CATALOG

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, con, name):
    df = CATALOG[name].plan(spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if CATALOG[name].sql is None:
        assert rows
        return
    assert rows or CATALOG[name].plan(spark, LARGER).count(), "a query without rows shows nothing"
    found = con.execute(CATALOG[name].sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == want


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_has_its_own_words():
    """Lists that decide results are written out in the SQL, not taken from the operators."""
    import inspect

    from lorespark.operators import alerts, context, gaps, quality
    from lorespark.plans import CATALOG as _  # noqa: F401

    lists = {"STRATEGIC": context, "NOT_SCREENED": context, "LEAVING": context, "VERDICT_STATES": context, "DONE_WORDS": alerts, "PROMISES": alerts, "STOP_WORDS": alerts, "WAITING": gaps, "KEY_LABELS": gaps, "CLAIM": quality}
    import lorespark.plans as plans

    for name in plans.__all__:
        if name != "CATALOG":
            text = inspect.getsource(getattr(plans, name))
            for word, module in lists.items():
                assert hasattr(module, word)
                assert f"{module.__name__.rsplit('.', 1)[1]}.{word}" not in text, (name, word)
