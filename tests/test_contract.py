"""The driver contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"


def said(where: Path) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=where, capture_output=True, text=True, check=True).stdout.split()


def test_all_is_registered_without_a_session():
    has = str((ROOT / "foliospark/llm").exists())
    assert said(ROOT)[1:] == [has, has]


def test_rest_works_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "foliospark", tmp_path / "foliospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, pipeline, op = said(tmp_path)
    assert int(n) >= 45 and (pipeline, op) == ("False", "False")


def test_nothing_else_imports_them():
    for p in (ROOT / "foliospark").rglob("*.py"):
        assert "llm" in p.parts or "foliospark.llm" not in p.read_text()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "kind", "key", "pages"]
