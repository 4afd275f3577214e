"""The driver's contract, with and without the optional parts; SQL parity of the document-table queries."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import parity
import pytest

import __spark_entry__ as entry
from gridmill import oracle, queries

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"doc_id", "decision", "issues"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_document_query_has_sql():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == {"result_json"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_parity(spark, name):
    assert parity.compare(spark, SF, name, queries.queries()[name], oracle.oracle_sql()[name]) == ""


def test_result_json(spark):
    import json

    rows = queries.result_json(spark, SF).limit(20).collect()
    for r in rows:
        body = json.loads(r.json)
        assert body["review_required"] == (body["decision"] != "accepted")
        assert len(body["records"]) == body["summary"]["records"]
        assert [x["index"] for x in body["records"]] == list(range(len(body["records"])))
        assert len(body["review"]["issues"]) == body["summary"]["issues"]


def test_without_the_optional_parts(tmp_path):
    for name in ("gridmill", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "gridmill" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'decision' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "gridmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
