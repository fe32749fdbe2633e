import pytest

from sheaf.plans.oracles import ORACLES
from sheaf.plans.queries import QUERIES
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, db, name):
    assert compare(spark, db, FOLDER, QUERIES[name], ORACLES[name]) is None
