"""Compares a query's rows with its SQL's on the small test tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF_DIR):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value.item() if hasattr(value, "item") else value


def rows(columns: list[str], found) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in found)


def differences(spark, query, sql: str, connection, sf_dir: str = SF_DIR) -> list:
    df = query(spark, sf_dir)
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return [sorted(df.columns), sorted(relation.columns)]
    a, b = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    return [] if a == b else [(x, y) for x, y in zip(a, b) if x != y][:3] or [len(a), len(b)]
