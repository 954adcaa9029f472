import os

import pytest

from spanwright.llm.queries import QUERIES, SQL
from tests.oracles import DATA, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_document_has_ids(spark):
    expected = connect().execute("SELECT count(DISTINCT doc_id) FROM documents").fetchall()[0][0]
    assert QUERIES["p7_ids"](spark, DATA).select("doc_id").distinct().count() == expected
