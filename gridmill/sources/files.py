"""Documents in a folder or store as grids.

Files are read by Spark's binary source and parsed where they are read; one bad
file gives a row with its error, never a failed job.  The content goes no
further than the parser.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docx, pdf

PARSED = (
    "doc_id string, type string, bytes long, sha256 string, pages int, error string, "
    "texts array<struct<page:int,para_index:long,text:string>>, "
    "tables array<struct<page:int,index:int,has_merged_cells:boolean,bbox:array<double>,rows:array<array<string>>,boxes:array<array<array<double>>>>>"
)
_TYPE = pa.schema(
    [
        ("doc_id", pa.string()), ("type", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("pages", pa.int32()), ("error", pa.string()),
        ("texts", pa.list_(pa.struct([("page", pa.int32()), ("para_index", pa.int64()), ("text", pa.string())]))),
        ("tables", pa.list_(pa.struct([("page", pa.int32()), ("index", pa.int32()), ("has_merged_cells", pa.bool_()), ("bbox", pa.list_(pa.float64())), ("rows", pa.list_(pa.list_(pa.string()))), ("boxes", pa.list_(pa.list_(pa.list_(pa.float64()))))]))),
    ]
)


def parse(path: str, content: bytes) -> dict:
    """One document as a row of ``PARSED``."""
    suffix = path.rsplit(".", 1)[-1].lower()
    out = {"doc_id": path, "type": suffix, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "pages": None, "error": None, "texts": [], "tables": []}
    try:
        if suffix not in ("pdf", "docx"):
            raise ValueError("only .pdf and .docx documents are read")
        if not content:
            raise ValueError("the document is empty")
        if suffix == "docx":
            found = docx.read(content)
            out["texts"] = [{"page": None, "para_index": i, "text": t} for i, t in enumerate(found["paragraphs"], 1) if t]
            out["tables"] = [{"page": None, "index": i, "has_merged_cells": merged, "bbox": None, "rows": rows, "boxes": None} for i, (rows, merged) in enumerate(found["tables"])]
        else:
            pages = pdf.read(content)
            out["pages"] = len(pages)
            for number, page in enumerate(pages, 1):
                out["texts"].append({"page": number, "para_index": number, "text": "\n".join(page.lines())})
                for i, (box, rows, boxes) in enumerate(page.tables()):
                    out["tables"].append({"page": number, "index": i, "has_merged_cells": None, "bbox": list(box), "rows": [[c.strip() for c in r] for r in rows], "boxes": [[list(b) for b in r] for r in boxes]})
    except Exception as error:  # a bad file is a row, not a failed job
        out["error"] = f"{type(error).__name__}: {error}"[:500]
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """Parse ``path, content`` rows (batch or stream)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([parse(path, content.as_py() or b"")], schema=_TYPE)

    return files.select("path", "content").mapInArrow(run, PARSED)


def load(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every .pdf and .docx file below ``path`` (or each of several), parsed.  (Spark's binary source passes over files without any byte.)"""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,docx,PDF,DOCX}").load(path))


def tables_and_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables and table rows of parsed documents; rows of PDF tables have their cells' ``boxes``."""
    each = parsed.select("doc_id", F.posexplode("tables").alias("table_seq", "t"))
    found = each.select(
        "doc_id", "table_seq", "t.page", F.col("t.index").alias("table_index"), F.coalesce("t.has_merged_cells", F.lit(False)).alias("has_merged_cells"), "t.bbox"
    )
    rows = each.select("doc_id", "table_seq", "t.boxes", F.posexplode("t.rows").alias("row", "cells"))
    return found, rows.select("doc_id", "table_seq", "row", "cells", F.get("boxes", F.col("row")).alias("boxes"))
