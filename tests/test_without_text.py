"""The rest of the repository stands without the subpackage for text and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
ASK = """import __spark_entry__ as e, sys
from volframe.plans.registry import ORACLE_SQL, QUERIES
assert set(e.queries()) == set(QUERIES) and e.oracle_sql() == ORACLE_SQL
assert not any(m.startswith('volframe.llm') for m in sys.modules)"""


@pytest.mark.parametrize("gone", [("volframe/llm", "tests/llm"), ("volframe/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_text(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda at, names: [n for n in names if n in (".git", "__pycache__") or str((Path(at) / n).relative_to(ROOT)) in gone])
    assert not any((tmp_path / "repo" / g).exists() for g in gone)
    subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", check=True, timeout=120)
