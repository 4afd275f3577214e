"""Header matching, table classes, and mappings carried across pages.

A mapping is an array with one entry per profile column, in profile order: the
0-based source column, or null.  Aliases are few and known when the plan is made,
so they are a literal map inside the expression, not a join.
"""

from __future__ import annotations

import string
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_header
from ..plans.profile import Profile
from .tables import TABLE, assessed, row_statistics


def alias_map(profile: Profile) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(profile.aliases.items())])


def fields_of(cells: Column, profile: Profile) -> Column:
    """The profile column that each cell names as a header, or null."""
    lookup, foreign = alias_map(profile), foreign_letters(profile)
    # an alias as it is written needs no normalising
    written = F.create_map(*[F.lit(x) for x in chain.from_iterable(spellings(profile).items())])
    # most cells have a digit or letter that no alias has, which is seen sooner than their normalised text
    named = F.transform(cells, lambda c: F.when(~c.rlike(foreign), F.coalesce(F.element_at(written, c), F.element_at(lookup, normalize_header(c)))))
    # most rows have no other cells, which is seen without going through them one by one
    letters = foreign[1:-1] if foreign.startswith("[") else ""
    some = F.array_join(cells, "\0").rlike(rf"(?:^|\x00)[^{letters}\x00]*+(?:\x00|\z)")
    return F.when(some, named).when(cells.isNotNull(), F.array_repeat(F.lit(None).cast("string"), F.size(cells)))


def spellings(profile: Profile) -> dict[str, str]:
    """Fields by their aliases, both as the profile writes them and normalised."""
    return {a: c.name for c in profile.columns for a in c.aliases} | profile.aliases


def foreign_letters(profile: Profile) -> str:
    """Pattern of the ASCII letters and digits that no alias holds; normalising keeps each as its small letter, so a text with one is no alias."""
    known = set("".join(profile.aliases))
    foreign = [c for c in string.digits + string.ascii_letters if c.lower() not in known]
    return f"[{''.join(foreign)}]" if foreign else "(?!)"


def header_candidates(rows: DataFrame, profile: Profile) -> DataFrame:
    """Every row that may be a header with its mapping, duplicates and scores."""
    found = rows.where(F.col("row") < profile.table["header_search_rows"]).select(*TABLE, "row", "cells", fields_of(F.col("cells"), profile).alias("f"))
    n = len(profile.columns)
    mapping, doubles = _mapped(F.col("f"), profile)
    got = found.withColumn("mapping", mapping).withColumn("doubles", doubles)
    count = F.size(F.filter("mapping", lambda x: x.isNotNull()))
    needed = [i for i, c in enumerate(profile.columns) if c.required]
    have = sum((F.col("mapping")[i].isNotNull().cast("int") for i in needed), F.lit(0))
    return got.select(
        *TABLE,
        "row",
        "cells",
        "mapping",
        "doubles",
        (count / F.lit(n)).alias("score"),
        (have / F.lit(len(needed)) if needed else F.lit(1.0)).alias("required_score"),
        count.alias("n_mapped"),
    )


def header_match(tables: DataFrame, rows: DataFrame, profile: Profile) -> DataFrame:
    """Tables with their best header: most required columns, then most columns, then the earliest row."""
    best = header_candidates(rows, profile).groupBy(*TABLE).agg(
        F.max_by(F.struct("row", "cells", "mapping", "doubles", "score", "required_score"), F.struct("required_score", "score", -F.col("row"))).alias("m")
    )
    none = F.transform(F.sequence(F.lit(1), F.lit(len(profile.columns))), lambda _: F.lit(None).cast("int"))
    joined = tables.join(best, TABLE, "left")
    return joined.select(
        *[F.col(c) for c in tables.columns],
        F.coalesce("m.row", F.lit(0)).alias("header_row"),
        F.coalesce("m.cells", F.array().cast("array<string>")).alias("header"),
        F.coalesce("m.mapping", none).alias("mapping"),
        F.coalesce("m.doubles", F.array().cast("array<struct<column:int,field:string>>")).alias("doubles"),
        F.coalesce("m.score", F.lit(0.0)).alias("score"),
        F.coalesce("m.required_score", F.lit(0.0)).alias("required_score"),
    )


def missing_required(profile: Profile) -> Column:
    """Sorted names of required columns that the mapping lacks."""
    position = {name: i for i, name in enumerate(profile.fields)}
    names = [F.when(F.col("mapping")[position[r]].isNull(), F.lit(r)) for r in profile.required]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def classify(matched: DataFrame, profile: Profile) -> DataFrame:
    """Add ``missing`` and ``kind``: compatible, rejected (required columns missing) or unmatched."""
    low = F.col("score") < profile.table["minimum_header_match"]
    return matched.withColumn("missing", missing_required(profile)).withColumn(
        "kind", F.when(low, F.lit("unmatched")).when(F.size("missing") > 0, F.lit("rejected")).otherwise(F.lit("compatible"))
    )


def carry_mappings(classified: DataFrame) -> DataFrame:
    """Let unmatched tables that continue the page before take over its mapping; they become ``continued``.

    An unmatched first table of a page continues when the last table that
    matched is compatible, as wide, and on an earlier page, and every page in
    between was continued the same way.  Pages in between are counted within
    (document, anchor), so no window holds more than a document's tables.
    """
    order = Window.partitionBy("doc_id").orderBy("table_seq")
    anchor = F.last(
        F.when(F.col("kind") != "unmatched", F.struct("table_seq", "kind", "page", "column_count", "mapping")), ignorenulls=True
    ).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = classified.withColumn("anchor", anchor)
    fits = (
        (F.col("kind") == "unmatched")
        & (F.col("table_index") == 0)
        & (F.col("anchor.kind") == "compatible")
        & (F.col("column_count") == F.col("anchor.column_count"))
        & (F.col("page") > F.col("anchor.page"))
    )
    t = t.withColumn("fits", F.coalesce(fits, F.lit(False)))
    nth = F.sum(F.col("fits").cast("int")).over(Window.partitionBy("doc_id", "anchor.table_seq").orderBy("table_seq").rowsBetween(Window.unboundedPreceding, 0))
    continues = F.col("fits") & (F.col("page") == F.col("anchor.page") + nth)
    t = t.withColumn("continues", F.coalesce(continues, F.lit(False)))
    names = [c for c in classified.columns if c not in ("kind", "mapping", "header_row", "header", "doubles")]
    return t.select(
        *names,
        F.when(F.col("continues"), F.lit("continued")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("continues"), F.col("anchor.mapping")).otherwise(F.col("mapping")).alias("mapping"),
        F.when(~F.col("continues"), F.col("header_row")).alias("header_row"),
        F.when(F.col("continues"), F.array().cast("array<string>")).otherwise(F.col("header")).alias("header"),
        F.when(F.col("continues"), F.array().cast("array<struct<column:int,field:string>>")).otherwise(F.col("doubles")).alias("doubles"),
    )


def match_tables(tables: DataFrame, rows: DataFrame, profile: Profile) -> DataFrame:
    """Header match, class and carried mapping of every table."""
    return carry_mappings(classify(header_match(tables, rows, profile), profile))


def _mapped(f: Column, profile: Profile) -> tuple[Column, Column]:
    """Source column of each profile column, and later columns of a field, of the fields ``f`` that cells name."""
    mapping = F.array(*[F.nullif(F.array_position(f, F.lit(c)), F.lit(0).cast("long")).cast("int") - 1 for c in profile.fields])
    # later columns of a field, in the order in which their fields first repeat
    doubles = F.filter(
        F.transform(f, lambda name, i: F.struct(i.cast("int").alias("column"), name.alias("field"))),
        lambda x: x["field"].isNotNull() & (F.array_position(f, x["field"]) - 1 < x["column"]),
    )
    # nothing is sought where all names differ
    return mapping, F.when(F.size(F.array_distinct(f)) < F.size(f), doubles).otherwise(F.array().cast("array<struct<column:int,field:string>>"))


def assess_and_match(tables: DataFrame | None, rows: DataFrame, profile: Profile) -> DataFrame:
    """``match_tables`` of ``assess``, from one aggregation of the rows; of a header only what it needs is kept until the best is known.

    Without ``tables`` they are those that the rows name by their ``page`` and ``table_index``.
    """
    n, needed = len(profile.columns), [c.name for c in profile.columns if c.required]
    searched = rows.withColumn("f", F.when(F.col("row") < profile.table["header_search_rows"], fields_of(F.col("cells"), profile)))
    have = lambda names: sum((F.coalesce(F.array_contains("f", F.lit(c)), F.lit(False)).cast("int") for c in names), F.lit(0))
    # the better header has more required columns, then more columns, then comes earlier; other rows have no rank and are never taken
    rank = F.when(F.col("row") < profile.table["header_search_rows"], F.struct(have(needed).alias("required"), have(profile.fields).alias("mapped"), (-F.col("row")).alias("row")))
    own = ["page", "table_index"] if tables is None else []
    ranked = searched.select(*TABLE, *own, "row", "cells", "f", rank.alias("rank"))
    best = F.max_by(F.struct("row", "cells", "f", F.col("rank.required").alias("required"), F.col("rank.mapped").alias("mapped")), "rank").alias("m")
    grouped = ranked.groupBy(*TABLE).agg(*[F.max(c).alias(c) for c in own], *row_statistics(), best)
    if tables is None:
        grouped = grouped.withColumns({"has_merged_cells": F.lit(None).cast("boolean"), "bbox": F.lit(None).cast("array<double>")})
        found = assessed(grouped, [*TABLE, *own, "has_merged_cells", "bbox", "m"])
    else:
        found = assessed(tables.join(grouped, TABLE, "left"), [*tables.columns, "m"])
    mapping, doubles = _mapped(F.col("m.f"), profile)
    none = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.lit(None).cast("int"))
    met = F.col("m.f").isNotNull()
    headed = found.select(
        *[F.col(c) for c in found.columns if c != "m"],
        F.coalesce("m.row", F.lit(0)).alias("header_row"),
        F.coalesce("m.cells", F.array().cast("array<string>")).alias("header"),
        F.when(met, mapping).otherwise(none).alias("mapping"),
        F.when(met, doubles).otherwise(F.array().cast("array<struct<column:int,field:string>>")).alias("doubles"),
        F.coalesce(F.col("m.mapped") / F.lit(n), F.lit(0.0)).alias("score"),
        F.coalesce((F.col("m.required") / F.lit(len(needed))) if needed else F.when(F.col("m").isNotNull(), F.lit(1.0)), F.lit(0.0)).alias("required_score"),
    )
    return carry_mappings(classify(headed, profile))
