"""The entry module without the optional folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len([n for n in names if n.startswith('op') or n == 'pipeline']), len(names) > 50)"


@pytest.mark.parametrize("gone", [("memlake/llm", "tests/llm"), ("memlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_folders(tmp_path, gone):
    ignore = shutil.ignore_patterns(".git", "__pycache__", "*.parquet")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    for name in gone:
        path = tmp_path / "copy" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = os.environ | {"PYTHONPATH": str(tmp_path / "copy")}
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == ["0", "True"]


def test_errors_of_the_operators_are_not_swallowed(tmp_path):
    """A broken module of the subpackage isn't a missing one."""
    if not os.path.isdir(f"{ROOT}/memlake/llm"):
        pytest.skip("the folder isn't there")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "copy/memlake/llm/queries.py").write_text("import no_such_module_at_all")
    env = os.environ | {"PYTHONPATH": str(tmp_path / "copy")}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert said.returncode and "no_such_module_at_all" in said.stderr
