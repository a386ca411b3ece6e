"""The queries without the operators for training data load from a copy without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from galley.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["galley/llm", "tests/llm"], ["galley/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_what_can_be_deleted(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=copy, capture_output=True, text=True, timeout=300)
    names = set(out.stdout.split())
    assert out.returncode == 0 and set(QUERIES) <= names and "pipeline" not in names, out.stderr
    assert any(n.startswith("op1_") for n in names) == (copy / "galley/llm").is_dir()
