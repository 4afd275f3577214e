"""Table-level operators: assessment and stitching across pages.

Grids travel as two frames.  ``tables`` has one row per table (``doc_id, table_seq,
page, table_index, has_merged_cells, ...``), ``rows`` one per table row
(``doc_id, table_seq, row, cells``).  ``table_seq`` orders a document's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLE = ["doc_id", "table_seq"]

# The texts of warnings.
EMPTY = "empty table"
RAGGED = ("ragged: rows have [", "] columns (grid may be misdetected)")
SPARSE = "% of cells are empty (extraction may be off)"
MERGED_CELLS = "merged cells detected (Word exposes merged cells as repeated values)"
MERGED_PAGES = ("merged across pages [", "] (continuation guessed from matching columns)")


def assess(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``n_rows, column_count, n_cells, n_empty, empty_ratio, looks_clean, warnings``.

    A table without rows is not clean and has the one warning ``empty table``.
    ``column_count`` is null where rows differ in width.  More than two fifths
    of empty cells (by the ratio rounded to three places) is a warning.
    """
    stats = rows.groupBy(*TABLE).agg(*row_statistics())
    return assessed(tables.join(stats, TABLE, "left"), tables.columns)


def row_statistics() -> list[Column]:
    """What ``assess`` needs of a table's rows, as aggregates."""
    return [
        F.count("*").alias("n_rows"),
        F.array_sort(F.collect_set(F.size("cells"))).alias("widths"),
        F.sum(F.size("cells")).alias("n_cells"),
        F.sum(F.size("cells") - F.size(F.array_remove("cells", F.lit("")))).alias("n_empty"),
    ]


def assessed(joined: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of tables joined with their ``row_statistics``, and what ``assess`` adds."""
    empty = F.col("n_rows").isNull()
    ragged = F.size("widths") > 1
    ratio = F.when(empty, F.lit(None)).when(F.col("n_cells") == 0, F.lit(1.0)).otherwise(F.round(F.col("n_empty") / F.col("n_cells"), 3))
    sparse = ratio > 0.4
    listed = F.concat(F.lit(RAGGED[0]), F.array_join(F.col("widths").cast("array<string>"), ", "), F.lit(RAGGED[1]))
    percent = F.concat((ratio * 100).cast("int").cast("string"), F.lit(SPARSE))
    found = F.when(empty, F.array(F.lit(EMPTY))).otherwise(F.filter(F.array(F.when(ragged, listed), F.when(sparse, percent)), lambda w: w.isNotNull()))
    merged = F.coalesce(F.col("has_merged_cells"), F.lit(False))
    warnings = F.when(merged, F.concat(found, F.array(F.lit(MERGED_CELLS)))).otherwise(found)
    return joined.select(
        *[F.col(c) for c in columns],
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.when(~empty & ~ragged, F.col("widths")[0]).alias("column_count"),
        F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"),
        F.coalesce("n_empty", F.lit(0)).cast("long").alias("n_empty"),
        ratio.alias("empty_ratio"),
        warnings.alias("warnings"),
        (F.size(warnings) == 0).alias("looks_clean"),
    )


def stitch_islands(tables: DataFrame) -> DataFrame:
    """Add ``island``: the ``table_seq`` of the first of a run of tables that continue page by page.

    A table continues the one before it when both have the same column count and
    it lies on the next page.
    """
    order = Window.partitionBy("doc_id").orderBy("table_seq")
    continues = (F.col("column_count") == F.lag("column_count").over(order)) & (F.col("page") == F.lag("page").over(order) + 1)
    head = F.when(~F.coalesce(continues, F.lit(False)), F.col("table_seq"))
    return tables.withColumn("island", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def stitch(tables: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge every island into its first table; a first row that repeats the island's header is dropped.

    A merged table has ``merged_from_pages``, no bounding box, and is never clean.
    """
    islands = stitch_islands(tables)
    marks = islands.select(*TABLE, "island", "page")
    placed = rows.join(marks, TABLE)
    by_island = Window.partitionBy("doc_id", "island")
    header = F.min(F.when(F.col("table_seq") == F.col("island"), F.when(F.col("row") == 0, F.col("cells")))).over(by_island)
    repeats = (F.col("row") == 0) & (F.col("table_seq") != F.col("island")) & (F.col("cells") == header)
    kept = placed.withColumn("repeats", F.coalesce(repeats, F.lit(False))).where("not repeats")
    order = by_island.orderBy("table_seq", "row")
    new_rows = kept.select("doc_id", F.col("island").alias("table_seq"), (F.row_number().over(order) - 1).alias("row"), "cells", F.col("page").alias("source_page"))
    pages = islands.groupBy("doc_id", F.col("island").alias("table_seq")).agg(F.array_sort(F.collect_list("page")).alias("merged_from_pages"))
    heads = tables.join(pages, TABLE)
    many = F.size("merged_from_pages") > 1
    base = heads.select(
        *[F.col(c) for c in tables.columns if c not in ("n_rows", "column_count", "n_cells", "n_empty", "empty_ratio", "warnings", "looks_clean")],
        F.when(many, F.col("merged_from_pages")).alias("merged_from_pages"),
    )
    again = assess(base, new_rows)
    merged = F.col("merged_from_pages").isNotNull()
    note = F.concat(F.lit(MERGED_PAGES[0]), F.array_join(F.col("merged_from_pages").cast("array<string>"), ", "), F.lit(MERGED_PAGES[1]))
    return (
        again.withColumn("warnings", F.when(merged, F.concat("warnings", F.array(note))).otherwise(F.col("warnings"))).withColumn("looks_clean", ~merged & F.col("looks_clean")),
        new_rows,
    )


def location(capital: bool = False):
    """Where a table is, in words, from ``merged_from_pages`` (null if not merged), ``page`` and ``table_index``."""
    pages, page, index = F.col("merged_from_pages"), F.col("page").cast("string"), (F.col("table_index") + 1).cast("string")
    word = (lambda w: F.lit(w.capitalize())) if capital else F.lit
    span = F.concat(word("pages "), F.element_at(pages, 1).cast("string"), F.lit("-"), F.element_at(pages, -1).cast("string"))
    return F.when(pages.isNotNull() & (F.size(pages) > 1), span).when(page.isNotNull(), F.concat(word("page "), page)).when(index.isNotNull(), F.concat(word("table "), index)).otherwise(
        F.lit("Document table" if capital else "")
    )


def review_rows(tables: DataFrame) -> DataFrame:
    """The seven-column overview of a document's tables, numbered from 1."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq"))
    return tables.select(
        "doc_id",
        number.alias("table_number"),
        location().alias("location"),
        "n_rows",
        "column_count",
        "looks_clean",
        F.coalesce("has_merged_cells", F.lit(False)).alias("has_merged_cells"),
        F.array_join("warnings", "; ").alias("warnings"),
    )
