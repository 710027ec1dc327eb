"""Every query of the library against its SQL, rows and schema, at the smallest sizes."""

import duckdb
import pytest

from quarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    want = con.sql(catalogue.ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    kinds = {n: (str(got.schema.field(n).type).replace("large_", "").split("[")[0], str(want.schema.field(n).type).replace("large_", "").split("[")[0]) for n in names}
    assert all(a == b for a, b in kinds.values()), kinds
    rows = lambda t: sorted((tuple(norm(r[c]) for c in names) for r in t.select(names).to_pylist()), key=repr)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SF)
    assert rows.count() >= 0 and rows.columns


def test_every_name_finds_its_own_plural(spark):
    rows = catalogue.QUERIES["fuzzy_names"](spark, SF).where("match_rank = 1").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert all(r.match == r.name + "s" for r in rows)
