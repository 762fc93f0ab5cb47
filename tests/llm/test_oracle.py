"""Queries of the training-data operators that SQL can express equal it."""

import os

import pytest

from lexispark.llm import catalog
from tests.oracle_check import SF_DIR, connect, differences

pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_sql(spark, name):
    assert differences(spark, catalog.queries()[name], catalog.oracle_sql()[name], connect()) == []


def test_every_operator_is_registered():
    names = list(catalog.queries())
    assert names[0] == "pipeline" and [n.split("_")[0] for n in names[1:]] == [f"op{i}" for i in range(1, 14)]
