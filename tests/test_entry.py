"""The entry module, with and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_has_its_own_sql():
    import __spark_entry__ as entry

    assert all(isinstance(x, str) for x in entry.oracle_sql().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_optional_parts(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    says = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q); print(len(q), len(o))"
    for without in ([], ["corpus_pipeline.py"]):
        for name in without:
            (copy / name).unlink()
        run = subprocess.run([sys.executable, "-c", says], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert run.returncode == 0, run.stderr[-2000:]
