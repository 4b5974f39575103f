"""Every query of the core runs on the smallest tables and equals its SQL."""

from __future__ import annotations

import pytest

from histolith.plans import cells, models, pixels, problems, spatial
from tests.compare import check

QUERIES, ORACLES = {}, {}
for part in (problems, cells, pixels, spatial, models):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    check(QUERIES, ORACLES, name, spark, data, duck)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doublet_id", "cell_id", "relation"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
