"""The operators' queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerlens.llm import queries

from ..test_queries import SF, db, table  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, db, name):  # noqa: F811
    got = queries.queries()[name](spark, SF)
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert table(got.columns, got.collect()) == table(names, want.fetchall())
    assert duckdb.__version__
