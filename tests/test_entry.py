"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_have_the_same_names(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["number", "text", "rn"] and e.entry(spark).count() > 0


def test_imports_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, weftline.cli; q = e.queries(); assert 'sort_full' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, names in os.walk(f"{ROOT}/weftline"):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
