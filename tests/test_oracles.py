"""Every registered query against its oracle on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

from lodestone import catalog
from tests.oracle import compare

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    if name in catalog.ORACLES:
        assert compare(df, catalog.ORACLES[name], SF_DIR) == ""
    else:
        assert df.count() > 0
