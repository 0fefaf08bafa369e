from __future__ import annotations

import os
import subprocess
import sys

import pytest
from common import ROOT, SF

import __spark_entry__ as entry
from orrery.plans import registry


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_imports_without_the_text_operators(tmp_path):
    """The driver removes that folder and the pipeline; all else must work."""
    import shutil

    shutil.copytree(ROOT / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
