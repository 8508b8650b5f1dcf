"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

import compare
import pytest
from loomfield import catalog

_open: dict = {}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, name):
    db = _open.setdefault(sf, compare.connect(sf)) if sf not in _open else _open[sf]
    got, want = compare.both(spark, db, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
