"""The library works without the corpus operations."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_imports_without_the_corpus_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "specgraph"), tmp_path / "specgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
