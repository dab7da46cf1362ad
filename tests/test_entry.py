"""The driver contract holds, with and without the optional subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_subpackage(tmp_path):
    for p in ("corundum", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p)
    code = "import sys; sys.modules['corundum.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "corundum").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(import|from)\s.*\bllm\b", p.read_text())
