"""The entry module works without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quadrille", tmp_path / "quadrille", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bgp_join_2' in q and set(q) == set(o) and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quadrille.llm" not in path.read_text()
