"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_returns_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "source", "n_chars", "n_docs", "source_chars", "match_class"]
    assert out.count() == 30


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_optional_subpackage(tmp_path):
    """A copy without the optional folders still imports and lists the other queries."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_keyword' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-800:]


def test_no_module_outside_imports_the_subpackage():
    for path in (REPO / "lyrebird").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lyrebird.llm" not in path.read_text(), path
