"""Every query that has reference SQL agrees with it."""

import pytest

import check_sql
from cinderspark.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_sql.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = con.execute(SQL[name]).fetchdf()
    assert check_sql.difference(ours, theirs) is None


def test_every_query_is_known():
    assert set(SQL) <= set(QUERIES)
    assert not [name for name in QUERIES if "pipeline" in name]
