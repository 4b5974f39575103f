"""Every corpus query runs on the smallest tables and equals its SQL where it has one."""

from __future__ import annotations

import pytest

from histolith.llm.oracles import ORACLES
from histolith.llm.queries import QUERIES
from tests.compare import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    check(QUERIES, ORACLES, name, spark, data, duck)


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)
