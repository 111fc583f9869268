from __future__ import annotations

import __spark_entry__ as entry
from voxframe.plans import catalog


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and set(catalog.QUERIES) <= set(entry.queries())


def test_queries_match_their_sql(spark, small):
    """On the smallest tables, each query and the SQL it is compared with give the same rows."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    for name, sql in catalog.ORACLE_SQL.items():
        got = catalog.QUERIES[name](spark, small)
        names = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == names, name
        a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
        b = sorted((tuple(plain(v) for v in r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall()), key=repr)
        assert a == b, name


def test_queries_without_sql_run(spark, small):
    for name in catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys():
        assert catalog.QUERIES[name](spark, small).count() > 0, name
