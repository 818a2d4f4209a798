"""The driver's entry with and without the corpus subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q)
print(len(q), sum(n.startswith("op") and n[2].isdigit() for n in q), "pipeline" in q)
"""


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("folder", ["gone", "emptied"])
def test_core_stands_alone(tmp_path, pipeline, folder):
    from vectrail.plans.catalog import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc"))
    for part in ("vectrail/llm", "tests/llm"):
        shutil.rmtree(copy / part, ignore_errors=True)
        if folder == "emptied":
            (copy / part).mkdir()
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(QUERIES)), "0", "False"]
