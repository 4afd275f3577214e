"""What a user calls: one function per tool, each from a session and a path or frames to a DataFrame."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.paths import checked_path
from .operators import decide, documents, evaluate, export, tables
from .plans import store
from .plans.extraction import Extraction, extract
from .plans.manifest import load_manifest
from .plans.profile import Profile, builtin_profiles, load
from .sources import files

# What is said of a document in which nothing was found, and its readers.
NO_TABLES = {"pdf": "no tables detected on any page", "docx": "no tables detected in Word document"}
ENGINE = "gridmill"


def _source(path: str) -> str:
    """Local paths are checked, others (with a scheme) are left to the session."""
    return path if "://" in path else checked_path(path)


def parsed_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All documents below ``path`` (or each of several), parsed once: what was read lies in shared storage."""
    found = files.load(spark, [_source(p) for p in path] if isinstance(path, list) else _source(path))
    return store.materialise(found, "parsed-documents")


def page_count(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, pages``; null for Word documents and files that cannot be read."""
    return parsed_documents(spark, path).select("doc_id", "pages")


def extract_text(spark: SparkSession, path: str, page: int | None = None) -> DataFrame:
    """``doc_id, page, text, warning`` of PDF pages; the warning is there where no page of the document has text.

    A document that has no such ``page`` has one row, without text, whose warning says so.
    """
    parsed = parsed_documents(spark, path).where("type = 'pdf'")
    silent = ~F.exists("texts", lambda t: F.trim(t["text"]) != "")
    found = parsed.select("doc_id", F.when(silent, F.lit(documents.NO_PAGE_TEXT)).alias("warning"), F.inline("texts"))
    chosen = documents.select_page(found, page).select("doc_id", "page", "text", "warning")
    if page is None:
        return chosen
    beyond = F.concat(F.lit("page must be between 1 and "), F.col("pages").cast("string"), F.lit(f" (received {page})"))
    return chosen.unionByName(parsed.where(F.col("pages") < page).select("doc_id", F.lit(page).alias("page"), F.lit(None).cast("string").alias("text"), beyond.alias("warning")))


def extract_docx_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, para_index, text`` of Word paragraphs; blank ones are left out, numbers keep their gaps."""
    return parsed_documents(spark, path).where("type = 'docx'").select("doc_id", F.inline("texts")).select("doc_id", "para_index", "text")


@dataclass(frozen=True)
class Tables:
    documents: DataFrame
    tables: DataFrame
    rows: DataFrame


def extract_tables(spark: SparkSession, path: str, page: int | None = None, merge_multipage: bool = False) -> Tables:
    """Assessed tables and their rows; with ``merge_multipage`` stitched across pages."""
    parsed = parsed_documents(spark, path)
    found, rows = files.tables_and_rows(parsed)
    found = documents.select_page(found, page)
    rows = rows.join(found.select("doc_id", "table_seq"), ["doc_id", "table_seq"], "left_semi") if page is not None else rows
    found = tables.assess(found, rows)
    if merge_multipage:
        found, rows = tables.stitch(found, rows)
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.count_if(~F.col("looks_clean")).alias("tables_needing_review"))
    warning = F.when(F.col("type") == "docx", F.lit(NO_TABLES["docx"])).otherwise(F.lit(NO_TABLES["pdf"]))
    docs = parsed.select("doc_id", "type", "sha256", "pages", "error").join(counted, "doc_id", "left").na.fill(0, ["n_tables", "tables_needing_review"])
    none = F.array().cast("array<string>")
    docs = docs.select("*", F.col("doc_id").alias("source"), F.col("type").alias("source_type"), F.when(F.col("n_tables") == 0, F.array(warning)).otherwise(none).alias("warnings"))
    return Tables(docs, found, rows)


def extract_docx_tables(spark: SparkSession, path: str) -> Tables:
    """Word tables; they have no pages, so nothing is stitched."""
    return extract_tables(spark, path)


def table_to_csv(spark: SparkSession, path: str, page: int | None = None, index: int = 0) -> DataFrame:
    """``doc_id, csv`` of each document's table number ``index``."""
    found = extract_tables(spark, path, page)
    return export.one_table_csv(found.rows, found.tables, index).select("doc_id", "csv")


def docx_table_to_csv(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    return table_to_csv(spark, path, None, index)


def list_extraction_profiles(spark: SparkSession) -> DataFrame:
    """The built-in profiles."""
    return spark.createDataFrame(builtin_profiles(), "id string, version string, description string, columns array<string>, sha256 string")


def extract_with_profile(spark: SparkSession, path: str | list[str], profile: str | dict | Profile = "lab-coa-v1") -> tuple[Extraction, DataFrame]:
    """The extraction and the documents (with hash and fingerprint) of everything below ``path``.

    A file that cannot be read is a rejected document with its error.
    """
    checked = load(profile)
    parsed = parsed_documents(spark, path)
    found, rows = files.tables_and_rows(parsed)
    mark = decide.fingerprint(F.col("sha256"), checked, ENGINE, __version__, "gridmill_version", __version__)
    docs = parsed.select("doc_id", "type", "bytes", "sha256", "pages", "error", mark.alias("fingerprint"))
    return extract(docs, found, rows, checked), docs


#: Fixed value: what a report says of itself.
PRIVACY = "Report contains hashes and metrics, not extracted or expected cell values."


def evaluate_manifest(spark: SparkSession, path: str, output: str | None = None) -> dict:
    """The report of a manifest's cases held against their ground truth: metrics, minimums and whether they are reached.

    The cases are one batch, whatever their number.  A document that cannot be
    read is a rejected case.  With ``output`` the report is also stored as a local
    JSON file.
    """
    manifest = load_manifest(path)
    expected, cases = manifest.frames(spark)
    documents = sorted(r["document"] for r in cases.select("document").collect())
    found, docs = extract_with_profile(spark, documents, manifest.profile)
    named = docs.select("doc_id", "sha256", "fingerprint", F.regexp_replace("doc_id", "^file:/+", "/").alias("document"))
    placed = cases.join(named, "document", "left")
    values = found.record_fields.join(placed.select("case_id", "doc_id"), "doc_id")
    predicted = values.select("case_id", F.col("record_index").alias("row"), F.col("name").alias("field"), "value")
    decisions = placed.join(found.documents.select("doc_id", "decision"), "doc_id", "left").select("case_id", F.coalesce("decision", F.lit("rejected")).alias("decision"), "expected_decision")
    counts = store.materialise(evaluate.case_counts(predicted, expected, decisions), "case-counts")
    by_case = {r["case_id"]: r for r in evaluate.metrics(counts, by_case=True).collect()}
    facts = {r["case_id"]: r for r in counts.join(placed.select("case_id", "sha256", "fingerprint"), "case_id").collect()}
    gate = evaluate.gate(evaluate.metrics(counts), manifest.minimums).first()
    engine = {"name": ENGINE, "version": __version__}
    report = {
        "evaluation_report_schema_version": "1.0",
        "evidence_label": manifest.label,
        "passed": gate["passed"],
        "gridmill_version": __version__,
        "evaluation_manifest_sha256": manifest.sha256,
        "profile": {"id": manifest.profile.raw["id"], "version": manifest.profile.raw["version"], "sha256": manifest.profile.sha256},
        "metrics": {m: gate[m] for m in evaluate.METRICS},
        "minimums": manifest.minimums,
        "cases": [_case_report(facts[c["id"]], by_case[c["id"]], engine) for c in manifest.cases],
        "privacy": PRIVACY,
    }
    found.release()
    if output:
        place = checked_path(output)
        os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
        with open(place, "w", encoding="utf-8") as file:
            file.write(json.dumps(report, indent=2) + "\n")
    return report


def _case_report(fact, rates, engine: dict) -> dict:
    return {
        "id": fact["case_id"],
        "document_sha256": fact["sha256"],
        "extraction_fingerprint": fact["fingerprint"],
        "engine": engine,
        "decision": fact["decision"],
        "expected_decision": fact["expected_decision"],
        "decision_correct": bool(fact["decision_correct"]),
        "expected_records": fact["expected_records"],
        "extracted_records": fact["predicted_records"],
        **{m: rates[m] for m in ("field_precision", "field_recall", "field_f1", "exact_record_rate")},
    }


def export_document_tables(spark: SparkSession, path: str, output: str, kind: str, merge_multipage: bool = True) -> DataFrame:
    """Write all tables below ``path`` as xlsx, csv or json below ``output``; returns a row per document."""
    found = extract_tables(spark, path, merge_multipage=merge_multipage)
    if kind == "csv":
        export.write_lines(export.tables_csv_lines(found.documents, found.tables, found.rows), _source(output))
    elif kind == "xlsx":
        export.tables_workbooks(found.documents, found.tables, found.rows).write.parquet(_source(output))
    elif kind == "json":
        bodies = found.rows.groupBy("doc_id", "table_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"))
        found.tables.join(bodies, ["doc_id", "table_seq"], "left").write.json(_source(output))
    else:
        raise ValueError("an export is xlsx, csv or json")
    return found.documents.select("doc_id", "source_type", "n_tables", "tables_needing_review", "warnings")


def export_with_profile(spark: SparkSession, path: str, profile: str | dict | Profile, output: str, kind: str) -> DataFrame:
    """Write the extraction of everything below ``path``; returns decision, counts and hashes of each document."""
    found, docs = extract_with_profile(spark, path, profile)
    if kind == "csv":
        export.write_lines(export.extraction_csv_lines(found, docs), _source(output))
    elif kind == "xlsx":
        export.extraction_workbooks(found, docs).write.parquet(_source(output))
    elif kind == "json":
        export.result_json(found, docs).select("json").write.text(_source(output))
    else:
        raise ValueError("an export is xlsx, csv or json")
    return found.documents.join(docs.select("doc_id", "sha256", "fingerprint", "error"), "doc_id")


def save_workbooks(workbooks: DataFrame, folder: str) -> int:
    """Store ``doc_id, content`` as files of a local folder, one at a time; returns how many."""
    root = checked_path(folder)
    os.makedirs(root, exist_ok=True)
    n = 0
    for row in workbooks.toLocalIterator():
        name = os.path.basename(str(row["doc_id"])).rsplit(".", 1)[0] or "document"
        with open(os.path.join(root, f"{name}-{n}.xlsx"), "wb") as file:
            file.write(row["content"])
        n += 1
    return n
