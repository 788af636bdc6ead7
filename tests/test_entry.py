"""The entry file works whole, and without the text operators and their tests."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), *[n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"


def copy(tmp_path, *without: str) -> str:
    to = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db")
    shutil.copytree(REPO, to, ignore=lambda d, names: {*skip(d, names), *[n for n in names if os.path.relpath(os.path.join(d, n), REPO) in without]})
    return str(to)


def run(at: str, *args: str) -> subprocess.CompletedProcess:
    """In a process that finds all that this one finds, but the copy in place of this checkout."""
    found = [x for x in sys.path if x and os.path.abspath(x) != REPO and not os.path.abspath(x).startswith(os.path.join(REPO, ""))]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([at, *found]), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, *args], cwd=at, env=env, capture_output=True, text=True, timeout=300)


GONE = ("terrasieve/llm", "tests/llm")


@pytest.mark.parametrize("without", [GONE, (*GONE, "corpus_pipeline.py")])
def test_without_text_operators(tmp_path, without):
    at = copy(tmp_path, *without)
    looked = run(at, "-c", LOOK)
    assert looked.returncode == 0 and looked.stdout.split()[1:] == [], looked.stderr
    collected = run(at, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout + collected.stderr


@pytest.mark.parametrize("broken", ["corpus_pipeline.py", "terrasieve/plans/catalogue.py"])
def test_a_broken_module_is_not_hidden(tmp_path, broken):
    """Of what may be missing only that itself is forgiven, not what it imports, whether or not the text operators are there."""
    at = copy(tmp_path)
    with open(os.path.join(at, broken), "r+") as f:
        text = f.read()
        f.seek(0)
        f.write(text.replace("from __future__ import annotations\n", "from __future__ import annotations\n\nimport no_such_module\n", 1))
    done = run(at, "-c", LOOK)
    assert done.returncode and "no_such_module" in done.stderr
