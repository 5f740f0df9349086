"""The driver contract holds with and without the subpackage for training data."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_llm_subpackage():
    code = "import sys; sys.modules['weft.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'retrieval_bm25' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_the_llm_subpackage():
    for path in (REPO / "weft").rglob("*.py"):
        if "llm" not in path.parts:
            assert "weft.llm" not in path.read_text(), path
