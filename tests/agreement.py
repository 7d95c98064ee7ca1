"""Compare a query with its SQL on the given tables."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        [tuple(_plain(r[i]) for i in order) for r in rows], key=lambda r: [str(x) for x in r])


def compare(spark_df, db, sql):
    """Nothing when both agree, else what differs."""
    result = db.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = rows_of(expected_columns, result.fetchall())
    table = spark_df.toArrow()
    got = rows_of(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])))
    if sorted(expected_columns) != sorted(table.column_names):
        return f"columns {sorted(table.column_names)} for {sorted(expected_columns)}"
    if not expected:
        return "the SQL gives no rows"
    if len(got) != len(expected):
        return f"{len(got)} rows for {len(expected)}"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    types = [(type(g), type(e)) for g, e in zip(got[0], expected[0]) if type(g) is not type(e)]
    return f"types {types}" if types else None
