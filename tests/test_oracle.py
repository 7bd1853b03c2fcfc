"""Every query of the engine against the SQL that stands for it."""

import pytest
from conftest import rows

from braidlake.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).fetchdf())
