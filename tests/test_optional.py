"""The package without its optional parts: entry, queries and SQL are there all the same."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import __spark_entry__ as entry
names = set(entry.queries())
assert "flagship_entity_search" in names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_folder(tmp_path, pipeline):
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    (tmp_path / "repo/spanweave/llm/__pycache__").mkdir(parents=True)  # what deleting sources may leave
    env = {**os.environ, "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
