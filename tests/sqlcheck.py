"""Comparison of a query with its SQL."""

import os


def compare_with_sql(spark, sf_dir, query, sql):
    """Rows of a Spark query and of SQL in DuckDB over the same tables, both as sorted lists of strings by column name."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(str(r[names.index(c)]) for c in order) for r in result.fetchall())
    return got, want
