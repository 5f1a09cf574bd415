"""Every registered query of the tabular operators against its SQL on DuckDB."""

import duckdb
import pytest

from quarry.plans import more, reports, rules, scale  # noqa: F401  register their queries
from quarry.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall())
    else:
        assert got
