"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    package = tmp_path / "prismlake"
    package.mkdir()
    for child in (ROOT / "prismlake").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (package / child.name).symlink_to(child)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'duplicates' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for file in (ROOT / "prismlake").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"\b(import|from)\b.*\bllm\b", file.read_text()), file
