"""The driver contract, with and without the llm package."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_of_the_engine_has_sql():
    from groundsearch.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_llm_package():
    code = "import sys; sys.modules['groundsearch.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; from groundsearch.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "groundsearch").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "groundsearch.llm" not in path.read_text(), path
