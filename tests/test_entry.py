"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as contract


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
