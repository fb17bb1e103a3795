"""The rest of the library without the folders of the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 50 and 'pipeline' not in n and not any(k.startswith('op') for k in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_standalone.py"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_semantics.py", "tests/test_queries.py", "tests/test_segment.py", "-k", "not test_oracle"], cwd=tmp_path, check=True, timeout=1500)


def test_nothing_else_imports_llm():
    for p in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
