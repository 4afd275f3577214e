"""The whole extraction as one logical plan over a batch of documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decide, match, records, tables
from . import store
from .profile import Profile, load

#: Usable tables up to which their keys are broadcast, so that rows of other tables are not shuffled.
BROADCAST_TABLES = 1_000_000

TABLE_COLUMNS = {"page": "int", "table_index": "int", "has_merged_cells": "boolean", "bbox": "array<double>"}


class Extraction:
    """The frames of one run, keyed by ``doc_id``; each is made when it is first asked for.

    Grid rows, matched tables, records and counted tables are read by several
    frames.  They are written to shared storage once, so the parser runs once, a
    lost executor takes nothing with it and later plans are short; ``release``
    deletes them.

    With ``laid`` all rows of a document lie in one partition and are cheap to make
    again: they are not written, and not shuffled once more.  With ``once`` records
    are read by one frame and one action only, so they are not written either; what
    that frame does not need of them is never made.  With ``parts`` only these parts
    of fields (of ``records``: ``column, raw, value, codes, has_evidence, bbox``) are
    kept of records that are written, and of tables what issues and decisions are made
    of (all, if ``tables`` is among the parts); frames that need more cannot be asked
    for, but ``records``: where rows are ``laid`` they are made again with all parts,
    which takes less disk than to write and shuffle them.
    Without ``table_rows`` tables are those that the rows name by their ``page`` and
    ``table_index``.
    """

    def __init__(self, documents: DataFrame, table_rows: DataFrame | None, rows: DataFrame, profile: Profile, laid: bool = False, once: bool = False, parts: tuple[str, ...] | None = None) -> None:
        self.profile, self.laid, self.once, self.parts = profile, laid, once, parts
        self._documents, self._tables, self._rows, self._written = documents, table_rows, rows, []

    def _kept(self, frame: DataFrame, name: str) -> DataFrame:
        self._written.append(store.new_path(frame.sparkSession, name))
        return store.materialise(frame, name, self._written[-1])

    def release(self) -> None:
        """Delete what the run has written; its frames must not be read any more."""
        for path in self._written:
            store.remove(self._documents.sparkSession, path)
        self._written.clear()

    @cached_property
    def _read_rows(self) -> DataFrame:
        """Grid rows, with page and index of their table where no tables are given."""
        own = ["page", "table_index"] if self._tables is None else []
        rows = prepared(self._rows, {"boxes": "array<array<double>>"}).select("doc_id", "table_seq", *own, "row", "cells", "boxes")
        return rows if self.laid else self._kept(rows, "grid-rows")

    @property
    def _grid_rows(self) -> DataFrame:
        return self._read_rows.select("doc_id", "table_seq", "row", "cells", "boxes")

    @cached_property
    def _matched(self) -> DataFrame:
        """Tables with their header, class, carried mapping and those issues that do not depend on their records."""
        found = match.assess_and_match(None if self._tables is None else prepared(self._tables, TABLE_COLUMNS), self._read_rows, self.profile)
        return self._kept(records.table_issues(found, self.profile), "matched-tables")

    def _made(self, later: DataFrame | None = None) -> DataFrame:
        """Records with all parts of their fields, first records of keys and status, not written."""
        rows = self._grid_rows
        if not self.laid:
            usable = self._matched.where(F.col("kind").isin("compatible", "continued")).select(*tables.TABLE)
            if usable.count() <= BROADCAST_TABLES:
                rows = rows.join(F.broadcast(usable), tables.TABLE, "left_semi")
        return records.unique_check(records.record_values(self._matched, rows, self.profile, jvm=True, laid=self.laid, later=later), self.profile).drop("duplicate")

    @cached_property
    def _values(self) -> DataFrame:
        """What is kept of records."""
        found = self._made()
        if self.parts is not None:
            found = records.narrowed(found, self.profile, self.parts)
        return found if self.once else self._kept(found, "records")

    @cached_property
    def _records(self) -> DataFrame:
        """Records with their own issues, duplicate keys and status."""
        return records.viewed(self._values, self.profile)

    @cached_property
    def tables(self) -> DataFrame:
        """Matched tables with all their issues, record counts and accepted records."""
        found = decide.table_flags(self._matched, self._values)
        if self.parts is not None and "tables" not in self.parts:
            found = found.select(*tables.TABLE, "kind", "record_count", "accepted_count", "table_issues")
        return found if self.once else self._kept(found, "counted-tables")

    @cached_property
    def records(self) -> DataFrame:
        """Records with every issue that hangs on them."""
        if self.laid and self.parts is not None:
            later = self.repeats.groupBy("doc_id", F.col("first_index").alias("record_index")).agg(F.sort_array(F.collect_list(F.col("record_index"))).alias("later"))
            return decide.record_issues(records.viewed(self._made(later), self.profile), self.profile)
        return decide.record_issues(self._records)

    @cached_property
    def _counts(self) -> DataFrame:
        return decide.document_counts(self._documents, self.tables)

    @cached_property
    def issues(self) -> DataFrame:
        """Every distinct issue of a document, in order."""
        return decide.all_issues(decide.document_issues(self._counts, self.profile), self.tables, self._records)

    @cached_property
    def issue_codes(self) -> DataFrame:
        """``doc_id, scope, code`` of every distinct issue of a document."""
        return decide.distinct_issues(decide.document_issues(self._counts, self.profile), self.tables, self._records)

    @cached_property
    def whole_document_issues(self) -> DataFrame:
        """``doc_id, n, issue`` of the issues of whole documents, which are all distinct and need no cell's value."""
        return decide.document_issues(self._counts, self.profile)

    @cached_property
    def documents(self) -> DataFrame:
        """Decision and summary."""
        return decide.decisions(self._counts, decide.issue_totals(decide.document_issues(self._counts, self.profile), self.tables, self._records))

    @cached_property
    def listed_documents(self) -> DataFrame:
        """``documents`` with ``listed``, the JSON texts of their issues in order: issues are gone through once for both."""
        totals = self.issues.groupBy("doc_id").agg(
            F.count("*").alias("issues"),
            F.max(F.col("issue.code").isin(*decide.FATAL)).alias("fatal"),
            F.transform(F.sort_array(F.collect_list(F.struct("issue_number", "json"))), lambda x: x["json"]).alias("listed"),
        )
        return decide.decisions(self._counts, totals, "listed")

    @cached_property
    def verdicts(self) -> DataFrame:
        """``doc_id, decision`` of every document, without a list of its issues."""
        return decide.verdicts(self._documents, decide.table_flags(self._matched, self._values, flaws=True), self.profile)

    @property
    def places(self) -> DataFrame:
        """``doc_id, table_seq, row, record_index`` of every record."""
        return self._values.select("doc_id", "table_seq", "row", "record_index")

    @property
    def repeats(self) -> DataFrame:
        """``doc_id, first_index, record_index`` of every record whose key was met before: these issues are all distinct."""
        return self._values.where("first_of_key < record_index").select("doc_id", F.col("first_of_key").alias("first_index"), "record_index")

    @property
    def cell_issues(self) -> DataFrame:
        """``doc_id, record_index, row, field, code`` of every issue of a cell."""
        found = self._values.select("doc_id", "record_index", "row", "flawed", *[f"codes{i}" for i in range(len(self.profile.fields))])
        # written, because a filter on codes that are still expressions would repeat them without end
        found = self._kept(found, "cell-codes") if self.once else found
        each = found.where("flawed").select("doc_id", "record_index", "row", F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"codes{i}").alias("codes")) for i, name in enumerate(self.profile.fields)])))
        return each.select("doc_id", "record_index", "row", "field", F.explode("codes").alias("code"))

    def field(self, name: str) -> DataFrame:
        """The rows of ``record_fields`` of one profile column."""
        return self._values.select(*self._field_columns(self.profile.fields.index(name)))

    def _field_columns(self, i: int) -> list:
        part = lambda p: F.col(f"{p}{i}").alias(p)
        evidence = F.when(F.col(f"has_evidence{i}"), F.struct("page", "table_index", "row", part("column"), part("bbox")))
        return ["doc_id", "record_index", F.lit(self.profile.fields[i]).alias("name"), part("raw"), part("value"), evidence.alias("evidence")]

    @property
    def record_fields(self) -> DataFrame:
        """One row per record and profile column."""
        return self._records.select("doc_id", "record_index", "page", "table_index", "row", F.explode("fields").alias("f")).select(
            "doc_id", "record_index", "f.name", "f.raw", "f.value", F.when(F.col("f.has_evidence"), F.struct("page", "table_index", "row", "f.column", "f.bbox")).alias("evidence")
        )

    @property
    def record_cells(self) -> DataFrame:
        """``doc_id, record_index, cells array<struct<field, value>>`` of every record."""
        return self._records.select("doc_id", "record_index", F.transform("fields", lambda f: F.struct(f["name"].alias("field"), f["value"].alias("value"))).alias("cells"))

    @property
    def wide(self) -> DataFrame:
        """Records with one column per profile column, holding canonical text."""
        return self._values.select("doc_id", "record_index", "status", *[F.col(f"value{i}").alias(name) for i, name in enumerate(self.profile.fields)])

    @property
    def reports(self) -> DataFrame:
        """One row per table: status, header, mapping, records and issues."""
        used = F.col("kind").isin("compatible", "continued")
        status = F.when(F.col("kind") == "rejected", F.lit("rejected")).when(F.size("table_issues") > 0, F.lit("needs_review")).when(F.col("kind") == "unmatched", F.lit("not_matched")).otherwise(F.lit("accepted"))
        names = F.array(*[F.lit(f) for f in self.profile.fields])
        mapping = F.filter(
            F.transform("mapping", lambda c, i: F.struct(F.get(names, i).alias("field"), c.alias("source_column"), F.get(F.col("header"), c).alias("source_header"))),
            lambda x: x["source_column"].isNotNull(),
        )
        return self.tables.select(
            "doc_id",
            "table_seq",
            "page",
            "table_index",
            status.alias("status"),
            "header_row",
            F.round(F.when(F.col("kind") == "continued", F.lit(0.0)).otherwise(F.col("score")), 3).alias("header_match"),
            F.when(used, mapping).alias("column_mapping"),
            F.when(used, F.col("unmapped_headers")).alias("unmapped_headers"),
            "record_count",
            F.col("table_issues").alias("issues"),
        )


def prepared(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``frame`` with columns it lacks as nulls."""
    for name, kind in columns.items():
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame


def extract(
    documents: DataFrame, table_rows: DataFrame | None, rows: DataFrame, profile: str | dict | Profile, laid: bool = False, once: bool = False, parts: tuple[str, ...] | None = None
) -> Extraction:
    """Extract every document by one profile.

    ``documents`` has ``doc_id``; ``table_rows`` one row per table (``doc_id,
    table_seq`` and what there is of ``page, table_index, has_merged_cells,
    bbox``); ``rows`` one per table row (``doc_id, table_seq, row, cells``, and
    ``boxes`` where the places of cells are known).

    Assessment and header search aggregate the rows where they lie.  Rows of tables
    that have no use are left out before anything is shuffled where the keys of the
    others, which are counted first, may be broadcast; the rest is shuffled once, by
    document, and the windows above that join need no other exchange where
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false (``plans.session``
    sets it).  ``laid``, ``once``, ``parts`` and leaving out ``table_rows`` are as in
    ``Extraction``.
    """
    return Extraction(documents, table_rows, rows, load(profile), laid, once, parts)


def from_grids(grids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, tables and rows from nested grids: ``doc_id, tables array<struct<page, index, rows, has_merged_cells>>``."""
    each = grids.select("doc_id", F.posexplode("tables").alias("table_seq", "t"))
    found = each.select("doc_id", "table_seq", F.col("t.page").cast("int").alias("page"), F.col("t.index").cast("int").alias("table_index"), F.col("t.has_merged_cells").alias("has_merged_cells"))
    rows = each.select("doc_id", "table_seq", F.posexplode("t.rows").alias("row", "cells"))
    return grids.select("doc_id"), found, rows
