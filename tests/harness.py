"""Holds a query's rows against its SQL in DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


def difference(spark, query, sql, sf_dir):
    """None if equal, else what differs."""
    got = query(spark, sf_dir)
    con = connect(sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    description = want.description
    values = want.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}
    types = {d[0]: kinds.get(str(d[1]), str(d[1])) for d in description}
    if types != dict(got.dtypes):
        return f"types {sorted(got.dtypes)} and {sorted(types.items())}"
    mine, theirs = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, values)
    if mine != theirs:
        off = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"{len(mine)} and {len(theirs)} rows; {off}"
    return None
