"""Word and PDF files end to end: sources, API, exports, stream, manifest, command line."""

import csv
import hashlib
import io
import json
import os
import time
import zipfile
import zlib
from xml.etree import ElementTree

import pytest

from gridmill import __main__ as cli
from gridmill import api
from gridmill.operators import evaluate
from gridmill.plans.manifest import ManifestError, load_manifest
from gridmill.plans.session import tune
from gridmill.sources import docx, files, pdf
from gridmill.streaming import drops

INVOICE = [["Item", "Qty", "Price"], ["Widget", "3", "12.50"], ["Gadget", "1", "40.00"], ["Bolt", "10", "0.25"]]
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def tbl(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(c if c.startswith("<w:tc>") else f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def pdf_bytes(pages, compress=True):
    """A ruled table of strings on each page."""
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {len(pages)}/Kids[{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}]>>", "<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    parts = [o.encode() for o in objects]
    for i, rows in enumerate(pages):
        body, x0, y0, w, h = [], 72, 720, 100, 20
        for r, row in enumerate(rows):
            for c, cell in enumerate(row):
                body.append(f"{x0 + c * w} {y0 - (r + 1) * h} {w} {h} re S")
                safe = cell.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
                body.append(f"BT /F1 10 Tf {x0 + c * w + 4} {y0 - (r + 1) * h + 6} Td ({safe}) Tj ET")
        data = "\n".join(body).encode("cp1252")
        kind = "/Filter/FlateDecode" if compress else ""
        data = zlib.compress(data) if compress else data
        parts.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Contents {5 + 2 * i} 0 R>>".encode())
        parts.append(f"<<{kind}/Length {len(data)}>>\nstream\n".encode() + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{i} 0 obj\n".encode() + x + b"\nendobj\n" for i, x in enumerate(parts, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"


def test_word_text_and_merged_cells():
    span = "<w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("Results") + "</w:tc>"
    start = "<w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>" + p("down") + "</w:tc>"
    more = "<w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc>"
    found = docx.read(docx_bytes(p("Head") + "<w:p/>" + p(" Batch: LAB-2026-001 ") + tbl([[span], [start, "a"], [more, "b"]])))
    assert found["paragraphs"] == ["Head", "", "Batch: LAB-2026-001"]
    assert found["tables"] == [([["Results", "Results"], ["down", "a"], ["down", "b"]], True)]
    with pytest.raises(zipfile.BadZipFile):
        docx.read(b"nothing")


@pytest.mark.parametrize("compress", [True, False])
def test_ruled_pdf_tables(compress):
    pages = pdf.read(pdf_bytes([INVOICE, [["a(b)\\", ""], ["é", "x y"]]], compress))
    assert [t[1] for t in pages[0].tables()] == [INVOICE]
    assert pages[0].tables()[0][0] == (72, 72, 372, 152)
    assert pages[0].tables()[0][2][1][2] == (272, 92, 372, 112)
    assert [t[1] for t in pages[1].tables()] == [[["a(b)\\", ""], ["é", "x y"]]]
    assert pages[0].lines()[0].split() == ["Item", "Qty", "Price"]
    with pytest.raises(ValueError):
        pdf.read(b"no pdf")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    (root / "invoice.pdf").write_bytes(pdf_bytes([INVOICE]))
    (root / "two.pdf").write_bytes(pdf_bytes([INVOICE[:3], [INVOICE[0], INVOICE[3]]]))
    (root / "bad_type.docx").write_bytes(docx_bytes(p("x") + tbl([INVOICE[0], ["=Widget", "many", "12.50"]])))
    (root / "broken.pdf").write_bytes(b"%PDF-1.4 nothing here")
    (root / "odd.docx").write_bytes(b"PK nothing")
    return root


def name(r):
    return r.doc_id.rsplit("/", 1)[-1]


def test_extraction_of_files(spark, folder):
    found, docs = api.extract_with_profile(tune(spark), str(folder), "invoice-lines-v1")
    got = {name(r): (r.decision, r.records) for r in found.documents.collect()}
    assert got == {"invoice.pdf": ("accepted", 3), "two.pdf": ("accepted", 3), "bad_type.docx": ("needs_review", 1), "broken.pdf": ("rejected", 0), "odd.docx": ("rejected", 0)}
    errors = {name(r): r.error for r in docs.collect()}
    assert errors["odd.docx"].startswith("BadZipFile") and errors["invoice.pdf"] is None
    assert files.parse("x.docx", b"")["error"].endswith("the document is empty") and "only" in files.parse("x.txt", b"x")["error"]
    values = [list(r)[3:] for r in found.wide.where("doc_id like '%invoice.pdf'").orderBy("record_index").collect()]
    assert values == INVOICE[1:]
    place = found.record_fields.where("doc_id like '%invoice.pdf' and record_index = 0 and name = 'unit_price'").first().evidence
    assert (place.page, place.table_index, place.row, place.column, place.bbox) == (1, 0, 1, 2, [272.0, 92.0, 372.0, 112.0])
    wrong, _ = api.extract_with_profile(spark, str(folder / "invoice.pdf"), "lab-coa-v1")
    assert wrong.documents.first().decision == "rejected" and wrong.records.count() == 0


def test_tables_text_and_csv(spark, folder):
    path = str(folder)
    assert {name(r): r.pages for r in api.page_count(spark, path).collect()}["two.pdf"] == 2
    assert api.extract_text(spark, path, 2).where("text is not null").count() == 1
    assert [r.text for r in api.extract_docx_text(spark, path).collect()] == ["x"]
    apart, merged = api.extract_tables(spark, path), api.extract_tables(spark, path, merge_multipage=True)
    assert apart.tables.count() == 4 and merged.tables.count() == 3
    two = merged.tables.where("doc_id like '%two.pdf'").first()
    assert (two.n_rows, two.merged_from_pages, two.looks_clean) == (4, [1, 2], False)
    text = api.table_to_csv(spark, str(folder / "invoice.pdf")).first().csv
    assert list(csv.reader(io.StringIO(text))) == INVOICE
    assert api.docx_table_to_csv(spark, path, 5).count() == 0
    with pytest.raises(ValueError):
        api.table_to_csv(spark, path, None, -1)
    assert api.list_extraction_profiles(spark).count() == 2


def sheets(content):
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
        out = {}
        for i, t in enumerate(titles, 1):
            cells = {}
            for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{ns}c"):
                v = c.find(f"{ns}v")
                cells[c.get("r")] = v.text if v is not None else "".join(x.text or "" for x in c.iter(f"{ns}t"))
            out[t] = cells
        return out


def test_exports(spark, folder, tmp_path):
    path = str(folder)
    done = api.export_document_tables(spark, path, str(tmp_path / "csv"), "csv").collect()
    assert {name(r): r.n_tables for r in done}["invoice.pdf"] == 1
    lines = "".join(f.read_bytes().decode() for f in (tmp_path / "csv").rglob("*.txt"))
    assert "'=Widget,many,12.50\r\n" in lines
    api.export_document_tables(spark, path, str(tmp_path / "xlsx"), "xlsx")
    books = {name(r): sheets(r.content) for r in spark.read.parquet(str(tmp_path / "xlsx")).collect()}
    assert books["invoice.pdf"]["Table 1"]["A6"] == "Item" and books["invoice.pdf"]["Review"]["A1"] == "table"
    assert books["bad_type.docx"]["Table 1"]["A7"] == "'=Widget"
    api.export_with_profile(spark, path, "invoice-lines-v1", str(tmp_path / "px"), "xlsx")
    books = {name(r): sheets(r.content) for r in spark.read.parquet(str(tmp_path / "px")).collect()}
    assert list(books["invoice.pdf"]) == ["Review", "Data", "Evidence"]
    assert books["invoice.pdf"]["Data"]["C2"] == "Widget" and books["bad_type.docx"]["Data"]["C2"] == "'=Widget"
    assert books["bad_type.docx"]["Review"]["B10"] == "invalid_type"
    api.export_with_profile(spark, path, "invoice-lines-v1", str(tmp_path / "pj"), "json")
    results = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "pj")).collect()]
    by = {r["document"]["bytes"]: r for r in results}
    invoice = by[len(pdf_bytes([INVOICE]))]
    assert invoice["decision"] == "accepted" and invoice["records"][0]["values"]["unit_price"] == "12.50" and invoice["review"]["issues"] == []
    assert [i["code"] for i in by[(folder / "bad_type.docx").stat().st_size]["review"]["issues"]] == ["invalid_type"]
    api.export_with_profile(spark, path, "invoice-lines-v1", str(tmp_path / "pc"), "csv")
    assert "1,accepted,Widget,3,12.50," in "".join(f.read_bytes().decode() for f in (tmp_path / "pc").rglob("*.txt"))
    assert api.save_workbooks(spark.read.parquet(str(tmp_path / "px")), str(tmp_path / "books")) == 5
    with pytest.raises(ValueError):
        api.export_document_tables(spark, path, str(tmp_path / "no"), "ods")


def test_drop_folder(spark, folder, tmp_path):
    into = tmp_path / "in"
    into.mkdir()
    for f in ("invoice.pdf", "bad_type.docx"):
        (into / f).write_bytes((folder / f).read_bytes())
    (into / "again.pdf").write_bytes((folder / "invoice.pdf").read_bytes())
    drops.run(spark, str(into), "invoice-lines-v1", str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    (into / "late.pdf").write_bytes((folder / "invoice.pdf").read_bytes())
    (into / "two.pdf").write_bytes((folder / "two.pdf").read_bytes())
    drops.run(spark, str(into), "invoice-lines-v1", str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = sorted(r.decision for r in spark.read.parquet(str(tmp_path / "out" / "documents")).collect())
    assert got == ["accepted", "accepted", "needs_review"]


def test_drop_folder_takes_old_files(spark, folder, tmp_path):
    into = tmp_path / "in"
    into.mkdir()

    def drop(name, source, days):
        (into / name).write_bytes((folder / source).read_bytes())
        at = time.time() - days * 86_400
        os.utime(into / name, (at, at))
        drops.run(spark, str(into), "invoice-lines-v1", str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()

    drop("new.pdf", "invoice.pdf", 0)
    drop("old.pdf", "two.pdf", 30)
    drop("copy.pdf", "invoice.pdf", 60)
    got = sorted(r.doc_id.rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "out" / "documents")).collect())
    assert got == ["new.pdf", "old.pdf"]


def test_manifest(spark, folder, tmp_path):
    rows = [dict(zip(("item", "quantity", "unit_price"), r, strict=True)) for r in INVOICE[1:]]
    body = {"evaluation_schema_version": "1.0", "evidence_label": "synthetic", "profile": "invoice-lines-v1", "minimums": {"field_f1": 1.0}, "cases": [{"id": "one", "document": str(folder / "invoice.pdf"), "expected_decision": "accepted", "expected_records": rows}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(body))
    manifest = load_manifest(str(path))
    expected, cases = manifest.frames(spark)
    found, docs = api.extract_with_profile(spark, str(folder / "invoice.pdf"), manifest.profile)
    from pyspark.sql import functions as F

    named = found.record_fields.select(F.lit("one").alias("case_id"), F.col("record_index").alias("row"), F.col("name").alias("field"), "value")
    decisions = cases.join(found.documents.select("decision"), F.lit(True)).select("case_id", "decision", "expected_decision")
    report = evaluate.gate(evaluate.metrics(evaluate.case_counts(named, expected, decisions)), manifest.minimums).first()
    assert report.passed and report.field_f1 == 1.0 and report.exact_record_rate == 1.0
    for wrong in ({"cases": []}, {"evaluation_schema_version": "2"}, {"cases": body["cases"] * 2}):
        path.write_text(json.dumps(body | wrong))
        with pytest.raises(ManifestError):
            load_manifest(str(path))


def test_evaluation(spark, folder, tmp_path):
    rows = [dict(zip(("item", "quantity", "unit_price"), r, strict=True)) for r in INVOICE[1:]]
    good = {"id": "one", "document": str(folder / "invoice.pdf"), "expected_decision": "accepted", "expected_records": rows}
    bad = {"id": "two", "document": str(folder / "broken.pdf"), "expected_decision": "rejected", "expected_records": []}
    body = {"evaluation_schema_version": "1.0", "evidence_label": "synthetic", "profile": "invoice-lines-v1", "minimums": {"field_f1": 1.0}, "cases": [good, bad]}
    path, out = tmp_path / "m.json", tmp_path / "reports" / "r.json"
    path.write_text(json.dumps(body))
    report = api.evaluate_manifest(spark, str(path), str(out))
    assert report == json.loads(out.read_text()) and report["passed"] and report["metrics"] == {"field_precision": 1.0, "field_recall": 1.0, "field_f1": 1.0, "exact_record_rate": 1.0, "decision_accuracy": 1.0, "cases": 2}
    assert [(c["id"], c["decision"], c["decision_correct"], c["expected_records"], c["extracted_records"]) for c in report["cases"]] == [("one", "accepted", True, 3, 3), ("two", "rejected", True, 0, 0)]
    assert all(len(c["extraction_fingerprint"]) == len(c["document_sha256"]) == 64 for c in report["cases"])
    assert "Widget" not in out.read_text() and report["evaluation_manifest_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    wrong = dict(good, expected_records=[{"item": "Incorrect", "quantity": "3", "unit_price": "12.50"}])
    path.write_text(json.dumps(dict(body, cases=[wrong])))
    assert cli.main(["evaluate", str(path)]) == 1
    path.write_text(json.dumps(body))
    assert cli.main(["evaluate", str(path)]) == 0


def test_upload_rules(spark):
    from gridmill.operators.documents import upload_checks

    rows = [("a/b.pdf", b"x%PDF-1.4"), ("c.docx", b"PK\x03\x04"), ("c.docx", b"xPK"), ("d.PDF", b"PK"), ("n" * 190 + ".PDF", b"%PDF-")]
    got = [(r.filename, r.signature_ok, r.size_ok) for r in upload_checks(spark.createDataFrame(rows, "name string, content binary")).collect()]
    assert got == [("b.pdf", True, True), ("c.docx", True, True), ("c.docx", False, True), ("d.PDF", False, True), ("n" * 160 + ".pdf", True, True)]


def test_pages_beyond_the_last(spark, folder):
    found = {name(r): (r.page, r.text, r.warning) for r in api.extract_text(spark, str(folder), 2).collect()}
    assert found["invoice.pdf"] == (2, None, "page must be between 1 and 1 (received 2)") and found["two.pdf"][2] is None


def test_command_line(spark, folder, tmp_path):
    assert cli.main(["profiles"]) == 0
    assert cli.main(["tables", str(folder / "invoice.pdf"), str(tmp_path / "a")]) == 0
    assert cli.main(["extract", str(folder / "invoice.pdf"), str(tmp_path / "b"), "--profile", "invoice-lines-v1"]) == 0
    assert cli.main(["extract", str(folder / "bad_type.docx"), str(tmp_path / "c"), "--profile", "invoice-lines-v1", "--kind", "json"]) == 2
    assert cli.main(["extract", str(folder), str(tmp_path / "d"), "--profile", "invoice-lines-v1"]) == 3
