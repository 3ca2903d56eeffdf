"""The driver's entry with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import json, __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""


@pytest.mark.parametrize("gone", [("brandloom/llm",), ("brandloom/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = tmp_path / "r" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "r" / "tests" / "llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "molecule_inventory" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout
    done = subprocess.run([sys.executable, "-c", "import bench"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
