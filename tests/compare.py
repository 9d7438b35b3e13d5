"""Comparing a query with its SQL, as bags of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def bag(rows):
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con


def same(df, sql, sf_dir):
    """Asserts equal columns, types and rows."""
    con = duck(sf_dir)
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    names = ", ".join(f'"{c}"' for c in columns)
    expected = bag(con.sql(f"select {names} from ({sql})").fetchall())
    assert bag(map(tuple, df.select(*columns).collect())) == expected
