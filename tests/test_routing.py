"""The routing corpus: decisions, records and issue codes of every case."""

import json
from pathlib import Path

import pytest

from gridmill.plans.extraction import extract, from_grids
from gridmill.plans.profile import load
from gridmill.plans.session import tune

DATA = Path(__file__).with_name("data")
GRIDS = "doc_id string, tables array<struct<page:int,index:int,rows:array<array<string>>,has_merged_cells:boolean>>"
PROFILE = json.loads((DATA / "water_results_profile.json").read_text())
CASES = json.loads((DATA / "routing_cases.json").read_text())


def run(spark, grids, profile):
    rows = [(k, [(t.get("page"), t["index"], t["rows"], t.get("has_merged_cells")) for t in tables]) for k, tables in grids.items()]
    return extract(*from_grids(spark.createDataFrame(rows, GRIDS)), profile)


@pytest.fixture(scope="module")
def corpus(spark):
    found = run(tune(spark), {c["id"]: c["tables"] for c in CASES}, PROFILE)
    return (
        {r.doc_id: r for r in found.documents.collect()},
        {k: [list(r)[3:] for r in rows] for k, rows in _by(found.wide.orderBy("doc_id", "record_index").collect()).items()},
        {k: [r.issue.code for r in rows] for k, rows in _by(found.issues.orderBy("doc_id", "issue_number").collect()).items()},
    )


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_profile_hashes():
    assert load(PROFILE).sha256 == "09cad0adb1518dfc03e121993145cc699e4ccf62c2b233d93d7689b799b3b557"
    assert load("invoice-lines-v1").sha256 == "89f09bbccbb26e96a4257fb54fe28f22c358f32151c5888e8f38f82e4ea7cfc4"
    assert load("lab-coa-v1").sha256 == "6f59be173b947f88b9f7e8cd1d659ce44b920b1403b25dfad87106c7597fa3b1"


@pytest.mark.parametrize("case", CASES, ids=[c["id"] for c in CASES])
def test_case(corpus, case):
    decisions, records, codes = corpus
    assert decisions[case["id"]].decision == case["expected_decision"]
    assert records.get(case["id"], []) == case["expected_records"]
    got = codes.get(case["id"], [])
    assert sorted(got) == sorted(case["issue_codes"])
    assert decisions[case["id"]].issues == len(case["issue_codes"])
