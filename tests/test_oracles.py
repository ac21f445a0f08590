"""Every query of the library against the same query in DuckDB."""

import math
import os

import duckdb
import pytest

from factorlake import plans

NAMES = sorted(plans.oracles())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return made


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(plans.oracles()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in cursor.fetchall())
