"""What is left works without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

WITHOUT = {"folders": ["plusminus/llm", "tests/llm"], "folders and pipeline": ["plusminus/llm", "tests/llm", "corpus_pipeline.py"]}
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50; assert not any(k == 'pipeline' or k.startswith('op1_') for k in q)"


@pytest.mark.parametrize("gone", WITHOUT.values(), ids=WITHOUT)
def test_the_rest_stands_alone(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "metastore_db", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-c", "import bench"], cwd=copy, env=env, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, env=env, check=True, timeout=120, capture_output=True, text=True)
    assert "error" not in found.stdout.lower().split("tests collected")[0].split("::")[0]


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/plusminus"):
        if "/llm" not in folder:
            assert not [n for n in names if n.endswith(".py") and "plusminus.llm" in open(f"{folder}/{n}", encoding="utf-8").read()]
