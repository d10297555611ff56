"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", [*registry.ORACLES])
def test_matches_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    asked = sql.execute(registry.ORACLES[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    assert found == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in asked.fetchall())
