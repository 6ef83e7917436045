"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from massflow.plans import catalogue

from .conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    want = want.select(*(f'"{c}"' for c in cols)).fetchall()
    assert _rows(map(tuple, got.select(*cols).collect())) == _rows(want)
