"""The driver's entry points, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from evstream.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_queries_are_registered():
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLES.keys() <= __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "evstream", tmp_path / "evstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys() and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
