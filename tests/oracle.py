"""Run a query and its SQL on the same tables and compare rows, column names and types."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple("null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


def compare(df, con, sql):
    got = con.execute(sql)
    names, kinds = [x[0] for x in got.description], {x[0]: str(x[1]) for x in got.description}
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(want)
