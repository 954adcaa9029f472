"""Every query of the core: equal to its SQL where there is one, else it runs."""

import os

import pytest

from spanwright.plans import artifacts, checks, diagnosis, exchange, measurements, records, repositories, streams, support, telemetry, tokens, trajectories
from tests.oracles import DATA, same

MODULES = (measurements, diagnosis, support, trajectories, tokens, telemetry, repositories, streams, records, checks, artifacts, exchange)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    df.count()


def test_names_are_unique():
    assert sum(len(m.QUERIES) for m in MODULES) == len(QUERIES)
    assert set(SQL) <= set(QUERIES)
