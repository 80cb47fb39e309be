"""The driver's entry can be read before there is a session, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


def run(folder):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=env, capture_output=True, text=True)


def test_without_a_session():
    done = run(ROOT)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("gone", [("graphloom/llm", "corpus_pipeline.py"), ("graphloom/llm",)])
def test_without_the_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "tests"))
    for name in gone:
        at = tmp_path / "r" / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    done = run(tmp_path / "r")
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[1:] == ["False", "False"]


def test_a_missing_dependency_is_told(tmp_path):
    """A package that the optional parts need must not vanish in silence."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "tests"))
    if not (tmp_path / "r" / "graphloom" / "llm").is_dir():
        pytest.skip("the optional parts are not there")
    (tmp_path / "r" / "graphloom" / "llm" / "common.py").write_text("import a_package_that_is_not_there\n")
    assert "a_package_that_is_not_there" in run(tmp_path / "r").stderr
