"""Every query with SQL gives the rows of its SQL; the others give rows."""

from __future__ import annotations

import os

import pytest
from compare import compare

from corvane import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    said = compare(spark, SF, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert said.startswith(("equal", "rows only")), said
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
