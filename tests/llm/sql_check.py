"""A query's rows against those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql).to_arrow_table()
    got = query(spark, sf)
    names = sorted(got.columns)
    assert names == sorted(want.column_names)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda t: sorted((tuple(norm(r[c]) for c in names) for r in t.to_pylist()), key=repr)
    a, b = rows(got.toArrow()), rows(want)
    assert len(a) == len(b)
    assert a == b
    return a
