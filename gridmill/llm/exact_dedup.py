"""Exact deduplication by a tree merge of sorted digest runs.

1. Every row is reduced to a header: SHA-256 of the text without ASCII white
   space, a second fingerprint (XXH64 and length of the same text) that verifies
   a digest match, the code points of the original, the id, and the place it was
   read at (input partition, and a block of ``RUN_ROWS`` rows within it).
   Headers are written to shared storage; partition and block, which are columns
   there, name the header's run, however the written files are split when they
   are read again.
2. Each run sorts its headers by digest and keeps one entry per text: the best
   row (most code points, then smallest id) and the number of rows.
3. Rounds: runs ``i*fan_in .. i*fan_in+fan_in-1`` exchange their entries and are
   merged into run ``i``, until one run is left; there is always one round at
   least.  What arrives are sorted pieces, which Spark's sorter (TimSort on keys
   of several columns) finds and merges; a streaming pass joins equal neighbours.
   The digest space is cut into as many slices of about ``slice_rows`` rows as
   the table has, which go through the rounds side by side, so no task ever
   merges more than slices.
4. The winners go back down to the entries of the first level, and from there to
   the headers of the same run: a text that fills a third of the table meets at
   most one entry per run, and a run has at most ``RUN_ROWS`` rows.

The text itself is read once and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

SPACE = r"[\x20\x09-\x0D]"
ENTRY = "run long, slice int, digest string, check long, size long, chars long, id long, n long"
#: Rows of the table for each slice of the digest space.
SLICE_ROWS = 20_000
#: Rows of a run.
RUN_ROWS = 20_000
_KEY = ["run", "slice", "digest", "check", "size"]


def headers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """One header per row; ``part`` is the partition that the row was read in, ``block`` counts its ``run_rows`` rows."""
    place = F.monotonically_increasing_id()  # the partition, then 33 bits of the row's number in it
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("chars"), F.regexp_replace(text, SPACE, "").alias("norm")).select(
        "id",
        "chars",
        F.sha2(F.col("norm").cast("binary"), 256).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.length("norm").cast("long").alias("size"),
        F.shiftright(place, 33).alias("part"),
        F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / run_rows).cast("long").alias("block"),
    )


def merge_sorted(batches):
    """Join neighbouring entries of the same text; the first one is the best.

    Streams: only one unfinished entry is carried from batch to batch.
    """
    carry = None
    for batch in batches:
        table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        table = table if carry is None else pa.concat_tables([carry, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for name in _KEY:
            col = table.column(name)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, table.num_rows - 1)).to_numpy().astype(bool)
        starts = np.flatnonzero(new)
        n = np.add.reduceat(table.column("n").to_numpy(), starts)
        merged = table.take(pa.array(starts)).set_column(table.column_names.index("n"), "n", pa.array(n, pa.int64()))
        carry = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def _merge(entries: DataFrame) -> DataFrame:
    best_first = [*_KEY, F.col("chars").desc(), F.col("id").asc_nulls_last()]
    return entries.sortWithinPartitions(*best_first).mapInArrow(merge_sorted, ENTRY)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, slice_rows: int = SLICE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Return one row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space; null counts
    as empty.  The row with the most code points in its original text, then the
    smallest id, stays.  A null id loses to any other id and is kept only when
    its whole group has none.  ``kept`` means ``id = keep_id``, so rows that
    repeat the id of the row that stays all carry it (``keep_rows`` takes one of
    them).  An empty table gives an empty result.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    written = materialise(headers(docs, id_col, text_col, run_rows), "headers")
    parts, blocks, rows = written.agg(F.max("part"), F.max("block"), F.count("*")).first()
    parts, slices = (parts or 0) + 1, max(1, -(-rows // slice_rows))
    runs = ((blocks or 0) + 1) * parts
    heads = written.withColumn("run", F.col("block") * parts + F.col("part"))
    slice_of = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % slices).cast("int").alias("slice")
    entries = heads.select("run", slice_of, "digest", "check", "size", "chars", "id", F.lit(1).cast("long").alias("n"))
    level = level0 = materialise(_merge(entries.repartition("slice", "run")), "runs")
    while level is level0 or runs > 1:
        runs = -(-runs // fan_in)
        parent = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))
        level = materialise(_merge(parent.repartition("slice", "run")), "merged")
    texts = level.select("digest", "check", "size")
    if texts.distinct().count() != texts.count():
        raise RuntimeError("a text has more than one winner")
    won = level.select("digest", "check", "size", F.col("id").alias("keep_id"), F.col("chars").alias("keep_chars"), F.col("n").alias("group_size"))
    down = level0.select("run", "digest", "check", "size", F.col("id").alias("run_id"), F.col("chars").alias("run_chars")).join(won, ["digest", "check", "size"])
    down = materialise(down, "winners")
    out = heads.select("run", "id", "chars", "digest", "check", "size").join(down, ["run", "digest", "check", "size"])
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group, with their columns as they are.

    Rows are told apart by id and text, so an id that comes with different texts
    keeps one row of each.  Of rows that repeat both, the one with the most code
    points stays, then the one whose columns hash lowest; rows that agree in every
    column are interchangeable.
    """
    groups = exact_groups(docs, id_col, text_col, **options).where("kept")
    stay = groups.select(F.col("keep_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).cast("long").alias("__id"),
        F.sha2(F.regexp_replace(text, SPACE, "").cast("binary"), 256).alias("__digest"),
        F.length(text).alias("__chars"),
    )
    joined = rows.join(stay, rows["__id"].eqNullSafe(stay["__id"]) & (rows["__digest"] == stay["__digest"]), "left_semi")
    if _repeats(docs, id_col):
        # rows of one id and text: the longest, then the first by what the row holds
        first = F.min_by("__row", F.struct((-F.col("__chars")).alias("c"), F.sha2(F.to_json("__row", {"ignoreNullFields": "false"}), 256).alias("h")))
        joined = joined.groupBy("__id", "__digest").agg(first.alias("__row"))
    return joined.select("__row.*")


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id occurs more than once (then rows of one id may be copies)."""
    return not docs.groupBy(id_col).count().where("count > 1").isEmpty()
