"""Every registered query agrees with its SQL on the smallest tables."""

import pytest
from oracle import compare

from telemetra.plans import registry

ENTRIES = registry.entries()


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, name):
    ok, note = compare(spark, ENTRIES[name], "/root/testdata/sf0.001")
    assert ok, note


def test_every_query_has_sql():
    assert [n for n, e in ENTRIES.items() if e.sql is None] == []
