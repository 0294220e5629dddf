"""Every registered query against its SQL text on the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, sf, name):
    verdict, rows, *_ = compare(spark, con, name, sf)
    assert verdict == "ok"
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["season", "slice", "n", "loss_first_order", "loss_base"]
    assert df.count() > 0
