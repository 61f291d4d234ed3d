from __future__ import annotations

import pytest
from oracle import same_rows

from lodestrata.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_works_without_the_subpackage(tmp_path):
    """The rest neither imports the subpackage nor needs it."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
sys.modules["lodestrata.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert set(e.queries()) == set(e.catalog.QUERIES)
assert not [m for m in sys.modules if m.startswith("lodestrata.llm.")]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
