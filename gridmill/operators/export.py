"""Sinks: CSV, JSON and Excel files of tables and of extractions, and the preview.

Lines and JSON texts are built as Columns, so a batch of any size is written by
Spark; Excel workbooks are zipped one document at a time on the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clipped, csv_line, spreadsheet_safe
from ..plans.extraction import Extraction
from .tables import location, review_rows

CSV_END = "\r\n"
# Fills by status, and the preview's limits.
FILLS = {"accepted": "E2F0D9", "needs_review": "FFF2CC", "rejected": "F4CCCC"}
PREVIEW_TABLES, PREVIEW_ROWS, PREVIEW_COLUMNS, PREVIEW_CHARS = 10, 25, 12, 160


def _texts(*values) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str | None) else v.cast("string") for v in values])


def table_csv(rows: DataFrame) -> DataFrame:
    """``doc_id, table_seq, csv``: each table as plain CSV (no spreadsheet safety)."""
    line = csv_line(F.col("cells"))
    each = rows.select("doc_id", "table_seq", "row", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: F.concat(r["line"], F.lit(CSV_END)))
    return each.groupBy("doc_id", "table_seq").agg(F.array_join(lines, "").alias("csv"))


def one_table_csv(rows: DataFrame, tables: DataFrame, index: int = 0) -> DataFrame:
    """CSV of each document's table number ``index`` (from 0)."""
    if isinstance(index, bool) or not isinstance(index, int) or index < 0:
        raise ValueError("a table index is a whole number from 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq")) - 1
    chosen = tables.select("doc_id", "table_seq", place.alias("place")).where(F.col("place") == index).drop("place")
    return table_csv(rows.join(chosen, ["doc_id", "table_seq"], "left_semi"))


def tables_csv_lines(documents: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: the CSV export of all tables of each document.

    ``documents`` has ``doc_id, source, source_type, warnings``; ``tables`` are
    assessed (and stitched, if wanted).
    """
    head = documents.select(
        "doc_id",
        F.posexplode(
            F.concat(
                F.array(_texts("source", F.col("source")), _texts("source_type", F.col("source_type"))),
                F.transform("warnings", lambda w: F.array(F.lit("document_warning"), w)),
                F.array(F.array().cast("array<string>")),
            )
        ).alias("n", "fields"),
    ).select("doc_id", F.lit(-1).alias("t"), F.lit(0).alias("part"), F.col("n").cast("long").alias("n"), "fields")
    tables = tables if "merged_from_pages" in tables.columns else tables.withColumn("merged_from_pages", F.lit(None).cast("array<int>"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq"))
    placed = tables.withColumn("number", number)
    clean = F.when(F.col("looks_clean"), F.lit("True")).otherwise(F.lit("False"))
    empty = F.array().cast("array<string>")
    top = placed.select(
        "doc_id",
        F.col("table_seq").alias("t"),
        F.lit(0).alias("part"),
        F.posexplode(
            F.array(F.array(F.concat(F.lit("Table "), F.col("number").cast("string")), location()), F.array(F.lit("looks_clean"), clean), F.array(F.lit("warnings"), F.array_join("warnings", "; ")), empty)
        ).alias("n", "fields"),
    ).select("doc_id", "t", "part", F.col("n").cast("long").alias("n"), "fields")
    body = rows.select("doc_id", F.col("table_seq").alias("t"), F.lit(1).alias("part"), F.col("row").cast("long").alias("n"), F.transform("cells", spreadsheet_safe).alias("fields"))
    tail = placed.select("doc_id", F.col("table_seq").alias("t"), F.lit(2).alias("part"), F.lit(0).cast("long").alias("n"), empty.alias("fields"))
    every = head.unionByName(top).unionByName(body).unionByName(tail)
    line_no = F.row_number().over(Window.partitionBy("doc_id").orderBy("t", "part", "n"))
    return every.select("doc_id", line_no.alias("line_no"), csv_line(F.col("fields")).alias("line"))


def issue_text(issues: str | Column) -> Column:
    return F.array_join(F.transform(issues, lambda i: F.concat_ws(": ", i["code"], i["message"])), "; ")


def extraction_csv_lines(found: Extraction, documents: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: the CSV export of an extraction; ``documents`` has ``doc_id, sha256``."""
    fields = found.profile.fields
    head = found.documents.join(documents.select("doc_id", "sha256"), "doc_id").select(
        "doc_id",
        F.posexplode(
            F.array(
                _texts("decision", F.col("decision")),
                _texts("profile", found.profile.raw["id"]),
                _texts("document_sha256", F.col("sha256")),
                F.array().cast("array<string>"),
                F.concat(_texts("record", "status"), F.transform(_texts(*fields), spreadsheet_safe), _texts("issues")),
            )
        ).alias("n", "fields"),
    )
    values = F.transform("fields", lambda f: spreadsheet_safe(f["value"]))
    body = found.records.select(
        "doc_id",
        (F.col("record_index") + 5).alias("n"),
        F.concat(F.array((F.col("record_index") + 1).cast("string"), F.col("status")), values, F.array(issue_text("issues"))).alias("fields"),
    )
    every = head.select("doc_id", F.col("n").cast("long").alias("n"), "fields").unionByName(body)
    return every.select("doc_id", (F.col("n") + 1).alias("line_no"), csv_line(F.col("fields")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``line`` of every document below ``path/doc_id=...``, in order, with CSV line ends."""
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").select("doc_id", "line").write.partitionBy("doc_id").option("lineSep", CSV_END).text(path)


def result_json(found: Extraction, documents: DataFrame) -> DataFrame:
    """``doc_id, json``: the whole result of each document.  ``documents`` has ``doc_id, type, bytes, sha256, fingerprint``."""
    evidence = lambda f: F.when(f["has_evidence"], F.struct(F.col("page"), F.col("table_index"), F.col("row"), f["column"].alias("column"), f["bbox"].alias("bbox")))
    pairs = lambda pick: F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], pick(f))))
    record = F.struct(
        F.col("record_index").alias("index"),
        "status",
        pairs(lambda f: f["value"]).alias("values"),
        pairs(lambda f: f["raw"]).alias("raw_values"),
        pairs(evidence).alias("evidence"),
        "unmapped_values",
        "issues",
    )
    records = found.records.select("doc_id", record.alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r"), lambda a, b: (a["index"] - b["index"]).cast("int")).alias("records"))
    reports = found.reports.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("table_seq", "page", "table_index", "status", "header_row", "header_match", "column_mapping", "unmapped_headers", "record_count", "issues")), lambda a, b: (a["table_seq"] - b["table_seq"]).cast("int")).alias("tables")
    )
    raw = found.profile.raw
    profile = F.struct(F.lit(raw["id"]).alias("id"), F.lit(raw["version"]).alias("version"), F.lit(raw["description"]).alias("description"), F.lit(found.profile.sha256).alias("sha256"), F.array(*[F.lit(f) for f in found.profile.fields]).alias("fields"))
    joined = documents.join(found.listed_documents, "doc_id").join(records, "doc_id", "left").join(reports, "doc_id", "left")
    document = F.struct(*[c for c in ("type", "bytes", "sha256", "pages") if c in documents.columns])
    body = F.struct(
        F.lit("1.0").alias("result_schema_version"),
        "decision",
        (F.col("decision") != "accepted").alias("review_required"),
        profile.alias("profile"),
        document.alias("document"),
        F.coalesce(records["records"], F.array().cast(records.schema["records"].dataType)).alias("records"),
        F.coalesce("tables", F.array().cast(reports.schema["tables"].dataType)).alias("tables"),
        F.struct("detected_tables", "matched_tables", "compatible_tables", "headerless_continuations", found.listed_documents["records"].alias("records"), "accepted_records", "issues").alias("summary"),
        F.struct("fingerprint").alias("audit"),
    )
    text = F.to_json(body)
    listed = F.concat(F.lit(',"review":{"issues":['), F.array_join(F.coalesce("listed", F.array().cast("array<string>")), ","), F.lit("]}}"))
    return joined.select("doc_id", F.concat(F.regexp_replace(text, r"\}$", ""), listed).alias("json"))


def preview(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """The first tables, rows and columns of each document, long texts clipped.

    ``preview_truncated`` tells whether rows or columns of a table are left out.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq"))
    shown = tables.withColumn("table_number", place).where(F.col("table_number") <= PREVIEW_TABLES)
    sized = rows.join(shown.select("doc_id", "table_seq", "table_number", "n_rows"), ["doc_id", "table_seq"])
    by_table = Window.partitionBy("doc_id", "table_seq")
    wide = F.max(F.size("cells")).over(by_table) > PREVIEW_COLUMNS
    sized = sized.withColumn("preview_truncated", wide | (F.col("n_rows") > PREVIEW_ROWS)).where(F.col("row") < PREVIEW_ROWS)
    return sized.select("doc_id", "table_number", "row", F.transform(F.slice("cells", 1, PREVIEW_COLUMNS), lambda c: clipped(c, PREVIEW_CHARS)).alias("cells"), "preview_truncated")


# -- Excel ---------------------------------------------------------------------


def safe_sheet_title(title: str, used: set[str]) -> str:
    """A title that a workbook takes and that is not used yet."""
    base = (re.sub(r"[\[\]:*?/\\]", " ", title).strip() or "Table")[:31]
    found, n = base, 1
    while found in used:
        n += 1
        found = base[: 31 - len(f" {n}")] + f" {n}"
    used.add(found)
    return found


def _reference(column: int, row: int) -> str:
    letters = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def _cell(value: object, at: str, style: int) -> str:
    look = f' s="{style}"' if style else ""
    if value is None:
        return f'<c r="{at}"{look}/>' if style else ""
    if isinstance(value, bool):
        return f'<c r="{at}"{look} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"{look}><v>{value}</v></c>'
    return f'<c r="{at}"{look} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


#: Styles: plain, bold, then a fill (and bold with it) for each status.
STYLES = {"plain": 0, "bold": 1, "accepted": 2, "needs_review": 3, "rejected": 4, "accepted bold": 5, "needs_review bold": 6, "rejected bold": 7}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _styles_xml() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    xfs = "".join(f'<xf fontId="{font}" fillId="{fill}" applyFont="1" applyFill="1"/>' for font, fill in [(0, 0), (1, 0), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4)])
    return (
        f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>'
        f'<fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="8">{xfs}</cellXfs></styleSheet>'
    )


def workbook(sheets: list[tuple[str, list[list[tuple[object, str]]], str | None]]) -> bytes:
    """An .xlsx file: sheets of (title, rows of (value, style name), first cell that scrolls)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, body: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body, zipfile.ZIP_DEFLATED)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        put(
            "[Content_Types].xml",
            f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        )
        put("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (t, _, _) in enumerate(sheets))
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", _styles_xml())
        for i, (_, rows, frozen) in enumerate(sheets):
            pane = ""
            if frozen:
                split = int(re.sub(r"\D", "", frozen)) - 1
                pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{split}" topLeftCell="{frozen}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            body = "".join(
                f'<row r="{r + 1}">' + "".join(_cell(v, _reference(c, r), STYLES[s]) for c, (v, s) in enumerate(row)) + "</row>" for r, row in enumerate(rows) if row
            )
            put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{_MAIN}">{pane}<sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def tables_workbooks(documents: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc_id, content``: a workbook per document with a Review sheet and one sheet per table."""
    tables = tables if "merged_from_pages" in tables.columns else tables.withColumn("merged_from_pages", F.lit(None).cast("array<int>"))
    overview = review_rows(tables).withColumn("where", F.col("location"))
    placed = tables.withColumn("table_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq")))
    bodies = rows.join(placed.select("doc_id", "table_seq", "table_number"), ["doc_id", "table_seq"]).groupBy("doc_id", "table_number").agg(
        F.array_sort(F.collect_list(F.struct("row", F.transform("cells", spreadsheet_safe).alias("cells")))).alias("body")
    )
    each = overview.join(bodies, ["doc_id", "table_number"], "left").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("table_number", "location", "n_rows", "column_count", "looks_clean", "has_merged_cells", "warnings", "body"))).alias("tables")
    )
    joined = documents.select("doc_id", "source", "warnings").join(each, "doc_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for d in batch.to_pylist():
                found = d["tables"] or []
                titles = ("table", "location", "rows", "columns", "looks_clean", "has_merged_cells", "warnings")
                review = [[(t, "bold") for t in titles]]
                for t in found:
                    style = "plain" if t["looks_clean"] else "needs_review"
                    review.append([(t[k], style) for k in ("table_number", "location", "n_rows", "column_count", "looks_clean", "has_merged_cells", "warnings")])
                review += [[("document warning", "plain"), (w, "plain")] for w in d["warnings"] or []]
                sheets, used = [("Review", review, "A2")], {"Review"}
                for t in found:
                    top = [[("source", "bold"), (d["source"], "bold")], [("location", "plain"), (t["location"], "plain")], [("looks_clean", "plain"), (t["looks_clean"], "plain")], [("warnings", "plain"), (t["warnings"], "plain")], []]
                    sheets.append((safe_sheet_title(f"Table {t['table_number']}", used), top + [[(c, "plain") for c in r["cells"]] for r in t["body"] or []], None))
                out.append((d["doc_id"], workbook(sheets)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("doc_id").type), pa.array([o[1] for o in out], pa.binary())], names=["doc_id", "content"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, content binary")


def extraction_workbooks(found: Extraction, documents: DataFrame) -> DataFrame:
    """``doc_id, content``: a workbook per document with Review, Data and Evidence; ``documents`` has ``doc_id, sha256, fingerprint``."""
    raw, fields = found.profile.raw, found.profile.fields
    records = found.records.select(
        "doc_id",
        F.struct(
            "record_index", "status", "page", "table_index", "row",
            F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["column"].alias("column"), spreadsheet_safe(f["raw"]).alias("raw"), spreadsheet_safe(f["value"]).alias("value"), f["has_evidence"].alias("known"), F.to_json(f["bbox"]).alias("bbox"))).alias("fields"),
            issue_text("issues").alias("issues"),
        ).alias("r"),
    ).groupBy("doc_id").agg(F.collect_list("r").alias("rows"))
    issues = found.issues.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("issue_number", F.col("issue.severity").alias("severity"), F.col("issue.code").alias("code"), F.col("issue.message").alias("message"), F.coalesce(F.to_json("issue.source"), F.lit("{}")).alias("source")))).alias("listed")
    )
    joined = documents.select("doc_id", "sha256", "fingerprint").join(found.documents.select("doc_id", "decision", F.col("records").alias("n_records"), F.col("issues").alias("n_issues")), "doc_id").join(records, "doc_id", "left").join(issues, "doc_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for d in batch.to_pylist():
                meta = [("decision", d["decision"]), ("profile", raw["id"]), ("profile_version", raw["version"]), ("document_sha256", d["sha256"]), ("extraction_fingerprint", d["fingerprint"]), ("records", d["n_records"]), ("issues", d["n_issues"])]
                review = [[(k, "bold" if i else f"{d['decision']} bold"), (v, "plain" if i else d["decision"])] for i, (k, v) in enumerate(meta)]
                review += [[], [(t, "bold") for t in ("severity", "code", "message", "source")]]
                review += [[(i[k], "plain") for k in ("severity", "code", "message", "source")] for i in d["listed"] or []]
                data = [[(t, "bold") for t in ("record", "status", *fields, "issues")]]
                proof = [[(t, "bold") for t in ("record", "field", "raw", "value", "page", "table", "row", "column", "bbox")]]
                for r in sorted(d["rows"] or [], key=lambda r: r["record_index"]):
                    number = r["record_index"] + 1
                    data.append([(v, r["status"]) for v in (number, r["status"], *[f["value"] for f in r["fields"]], r["issues"])])
                    for f in r["fields"]:
                        place = (r["page"], r["table_index"], r["row"], f["column"]) if f["known"] else (None,) * 4
                        proof.append([(v, "plain") for v in (number, f["name"], f["raw"], f["value"], *place, f["bbox"] or "")])
                out.append((d["doc_id"], workbook([("Review", review, "A10"), ("Data", data, "A2"), ("Evidence", proof, "A2")])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("doc_id").type), pa.array([o[1] for o in out], pa.binary())], names=["doc_id", "content"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, content binary")
