import os

import pytest

from readloom.llm import queries
from tests import parity

pytestmark = pytest.mark.skipif(not os.path.isdir(parity.DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    parity.compare(spark, parity.connect(), queries.queries()[name], queries.oracle_sql()[name])
