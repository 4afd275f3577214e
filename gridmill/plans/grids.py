"""Grids derived from the benchmark tables, so that the plans run on any scale factor.

``order_grid``: a document per order, a page for every five lines.  Header texts,
extra columns, missing headers on later pages, stray tables and broken headers
follow from the order's number.  ``event_grid``: a document per user, a page and
table per day, with ragged rows and gaps between days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER_PROFILE = {
    "profile_schema_version": "1.0",
    "id": "order-lines-v1",
    "version": "1.0.0",
    "description": "Lines of orders as a grid.",
    "table": {
        "unique_by": ["item"],
        "columns": [
            {"name": "item", "aliases": ["Item", "Description"], "required": True},
            {"name": "quantity", "aliases": ["Qty", "Quantity"], "type": "decimal", "required": True, "minimum": "0"},
            {"name": "unit_price", "aliases": ["Price", "Unit Price"], "type": "decimal", "required": True, "minimum": "0", "maximum": "90000"},
            {"name": "note", "aliases": ["Remark"], "type": "string"},
        ],
        "minimum_header_match": 0.75,
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ix, item, qty, price`` of every order line."""
    return _lines(spark, sf_dir).drop("final")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_lines``, and whether a line is the last of its order."""
    key = F.col("l_partkey")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # named before the window, so that what is above knows how lines are laid; texts are made after it, so that they are not shuffled
    numbered = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    ).withColumns({"ix": F.row_number().over(order) - 1, "final": F.lead(F.lit(True)).over(order).isNull()})
    qty = F.when(key % 17 == 0, F.lit("many")).when(key % 19 == 0, F.lit("")).when(key % 23 == 0, F.lit("-3")).otherwise(F.col("l_quantity").cast("long").cast("string"))
    return numbered.select(
        "doc_id",
        "ix",
        F.concat(F.lit("P"), key.cast("string")).alias("item"),
        qty.alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"),
        "final",
    )


def _header(doc: Column) -> Column:
    plain, odd = [F.lit(x) for x in ("Item", "Qty", "Price")], [F.lit(x) for x in (" DESCRIPTION ", "quantity:", "Unit  price!")]
    broken = F.array(F.lit("Item"), F.lit("Qty"), F.when(doc % 2 == 0, F.lit("Remark")).otherwise(F.lit("Total")))
    base = F.when(doc % 13 == 0, broken).when(doc % 2 == 0, F.array(*plain)).otherwise(F.array(*odd))
    return F.when(doc % 5 == 0, F.concat(base, F.array(F.when(doc % 2 == 0, F.lit("description")).otherwise(F.lit("Colour"))))).otherwise(base)


def order_grid(spark: SparkSession, sf_dir: str, named: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, tables and rows of the order grid; the last two read and shuffle the lines once each, by document.

    With ``named`` rows have the ``page`` and ``table_index`` of their table, which here is never without rows.
    """
    doc = F.col("doc_id")
    lines = _lines(spark, sf_dir).withColumn("table_seq", F.expr("ix div 5").cast("int")).withColumn("at", (F.col("ix") % 5).cast("int"))
    headed = (F.col("table_seq") == 0) | (doc % 3 != 0)
    first, stray, after = F.col("at") == 0, F.col("final") & (doc % 7 == 0), F.col("table_seq") + 1
    cells = F.array("item", "qty", "price")
    cells = F.when(doc % 5 == 0, F.concat(cells, F.array(F.concat(F.lit("c"), F.col("ix").cast("string"))))).otherwise(cells)
    partial = F.array(F.array(F.lit("Item"), F.lit("Code")), F.array(F.lit("x"), F.lit("")))
    strange = F.array(F.array(F.lit("Date"), F.lit("Operator")), F.array(F.lit(""), F.lit("")))
    odd = F.when(doc % 2 == 0, partial).otherwise(strange)
    at = lambda index: [after.alias("page"), F.lit(index).alias("table_index")] if named else []
    row = lambda seq, n, texts, index=0: F.struct(seq.alias("table_seq"), *at(index), n.alias("row"), texts.alias("cells"))
    data = F.array(row(F.col("table_seq"), F.col("at") + headed.cast("int"), cells))
    header = F.array(row(F.col("table_seq"), F.lit(0), _header(doc)))
    strays = F.array(*[row(after, F.lit(i), odd[i], 1) for i in range(2)])
    every = F.when(first & headed & stray, F.concat(data, header, strays)).when(first & headed, F.concat(data, header)).when(stray, F.concat(data, strays)).otherwise(data)
    table_of = lambda seq, page, index: F.struct(seq.alias("table_seq"), page.alias("page"), F.lit(index).alias("table_index"))
    page, extra = F.array(table_of(F.col("table_seq"), after, 0)), F.array(table_of(after, after, 1))
    tables = lines.where(first | stray).select("doc_id", F.inline(F.when(first & stray, F.concat(page, extra)).when(first, page).otherwise(extra)))
    documents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return documents, tables, lines.select("doc_id", every.alias("every")).select("doc_id", F.inline("every"))


def event_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, tables and rows of the event grid."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), "event_id", "event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("v")
    )
    by_day = Window.partitionBy("doc_id", "day")
    width = 2 + (F.min("event_id").over(by_day) % 2).cast("int")
    e = e.withColumn("w", width).withColumn("row", F.row_number().over(by_day.orderBy("event_id")) - 1)
    e = e.withColumn("table_seq", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("day")) - 1)
    ragged = ((F.col("doc_id") + F.col("day")) % 5 == 0) & (F.col("row") == 0)
    first = F.when(F.col("row") == 0, F.lit("type")).otherwise(F.col("event_type"))
    second = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("v"))
    third = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("x"))
    cells = F.slice(F.array(first, F.when(F.col("row") == 0, F.lit("value")).otherwise(second), F.when(F.col("row") == 0, F.lit("x")).otherwise(third)), F.lit(1), F.col("w"))
    cells = F.when(ragged, F.concat(cells, F.array(F.lit("more")))).otherwise(cells)
    rows = e.select("doc_id", "table_seq", "row", cells.alias("cells"))
    tables = e.where("row = 0").select("doc_id", "table_seq", (F.col("day") + 1).alias("page"), F.lit(0).alias("table_index"))
    return tables.select("doc_id").distinct(), tables, rows
