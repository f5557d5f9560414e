import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "hybrid_search" in q


def test_works_without_the_subpackage(tmp_path):
    """Nothing outside the subpackage imports it."""
    import shutil

    shutil.copytree(ROOT / "textweave", tmp_path / "textweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') and x[2:3].isdigit() for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
