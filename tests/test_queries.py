import os

import pytest

from readloom import queries
from tests import parity

pytestmark = pytest.mark.skipif(not os.path.isdir(parity.DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return parity.connect()


def test_every_query_has_an_oracle():
    assert queries.queries().keys() == queries.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_oracle(spark, con, name):
    parity.compare(spark, con, queries.queries()[name], queries.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
