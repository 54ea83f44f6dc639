"""The entry module with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def entry_of(folder: Path) -> subprocess.CompletedProcess:
    code = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())), any(n.startswith('op') for n in e.queries()))"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})


@pytest.fixture
def copy(tmp_path):
    for name in ("wordloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    return tmp_path


def test_without_the_subpackage(copy):
    shutil.rmtree(copy / "wordloom" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    out = entry_of(copy).stdout.split()
    assert int(out[0]) > 90 and out[1:] == ["0", "False"]


def test_a_broken_import_is_told(copy):
    if not (copy / "wordloom" / "llm").exists():
        pytest.skip("the subpackage is absent")
    (copy / "wordloom" / "llm" / "ann.py").write_text("import no_such_module_at_all")
    done = entry_of(copy)
    assert done.returncode and "no_such_module_at_all" in done.stderr
