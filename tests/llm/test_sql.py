from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same_rows  # noqa: E402

from lodestrata.llm import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_all_ten_are_registered():
    assert {int(name[2:].split("_")[0]) for name in catalog.QUERIES} == set(range(1, 11))
