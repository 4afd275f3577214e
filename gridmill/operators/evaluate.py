"""Extraction held against ground truth: field precision and recall, exact records, decisions, gates.

``predicted`` and ``expected`` are long: ``case_id, row, field, value`` with
``value`` null for blanks, which count on neither side.  Reports hold counts and
rates, never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import f1, ratio

METRICS = ("field_precision", "field_recall", "field_f1", "exact_record_rate", "decision_accuracy", "cases")


def nested(cells: DataFrame) -> DataFrame:
    """``case_id, row, cells array<struct<field, value>>`` of long cells."""
    return cells.groupBy("case_id", "row").agg(F.collect_list(F.struct("field", "value")).alias("cells"))


def compare_records(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts of cells (``true_positive, false_positive, false_negative``) and of records (``exact_records, predicted_records, expected_records``) of each ``case_id``.

    Both sides are ``nested``, with one row per record, and are shuffled as such,
    once.  Cells are bags: a cell that comes twice on one side and once on the other
    matches once.  Records agree by position in every field.
    """
    both = predicted.withColumnRenamed("cells", "p").join(expected.withColumnRenamed("cells", "e"), ["case_id", "row"], "full")
    equal = F.when(F.col("p") == F.col("e"), F.lit(True)).otherwise(F.sort_array("p") == F.sort_array("e"))
    given = lambda side: F.filter(F.coalesce(side, F.array().cast(predicted.schema["cells"].dataType)), lambda c: c["value"].isNotNull())
    sides = both.select("case_id", "p", "e", equal.alias("equal"), given(F.col("p")).alias("ps"), given(F.col("e")).alias("es"))
    times = lambda side, x: F.size(F.filter(side, lambda c: (c["field"] == x["field"]) & (c["value"] == x["value"])))
    bags = F.aggregate(F.array_distinct("ps"), F.lit(0), lambda n, x: n + F.least(times(F.col("ps"), x), times(F.col("es"), x)))
    same = F.when(F.col("equal"), F.size("ps")).otherwise(bags)
    counted = sides.select(
        "case_id",
        same.alias("same"),
        F.size("ps").alias("ps"),
        F.size("es").alias("es"),
        F.col("equal").alias("equal"),
        F.col("p").isNotNull().alias("p"),
        F.col("e").isNotNull().alias("e"),
    )
    return _case_sums(counted)


def _case_sums(counted: DataFrame) -> DataFrame:
    return counted.groupBy("case_id").agg(
        F.sum("same").alias("true_positive"),
        F.sum(F.col("ps") - F.col("same")).alias("false_positive"),
        F.sum(F.col("es") - F.col("same")).alias("false_negative"),
        F.count_if("equal").alias("exact_records"),
        F.count_if("p").alias("predicted_records"),
        F.count_if("e").alias("expected_records"),
    )


def compare_wide(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """``compare_records`` of sides with one row per record and one column per field, which both have: ``case_id, row`` and the fields.

    Every field is there once, so cells match by their place and no name is shuffled.
    """
    fields = [c for c in predicted.columns if c not in ("case_id", "row")]
    side = lambda frame, mark: frame.select("case_id", "row", *[F.col(f).alias(f"{mark}{i}") for i, f in enumerate(fields)], F.lit(True).alias(mark))
    both = side(predicted, "p").join(side(expected, "e"), ["case_id", "row"], "full")
    pairs = [(F.col(f"p{i}"), F.col(f"e{i}")) for i in range(len(fields))]
    total = lambda conditions: sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))
    exact = F.col("p").isNotNull() & F.col("e").isNotNull()
    for p, e in pairs:
        exact &= p.eqNullSafe(e)
    counted = both.select("case_id", total(p == e for p, e in pairs).alias("same"), total(p.isNotNull() for p, _ in pairs).alias("ps"), total(e.isNotNull() for _, e in pairs).alias("es"), exact.alias("equal"), "p", "e")
    return _case_sums(counted.withColumns({"p": F.col("p").isNotNull(), "e": F.col("e").isNotNull()}))


def record_counts(predicted: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases`` (``case_id``, ...) with their counts of cells and records, also those without cells; both sides long, ``nested`` or as in ``compare_wide``."""
    if any("cells" in side.columns or "field" in side.columns for side in (predicted, expected)):
        compared = compare_records(*[side if "cells" in side.columns else nested(side) for side in (predicted, expected)])
    else:
        compared = compare_wide(predicted, expected)
    return cases.join(compared, "case_id", "left").na.fill(0)


def case_counts(predicted: DataFrame, expected: DataFrame, decisions: DataFrame) -> DataFrame:
    """``record_counts`` of every case of ``decisions`` (``case_id, decision, expected_decision``), and whether its decision is right."""
    joined = record_counts(predicted, expected, decisions)
    return joined.withColumn("record_denominator", F.greatest("predicted_records", "expected_records")).withColumn(
        "decision_correct", F.col("decision").eqNullSafe(F.col("expected_decision")).cast("long")
    )


def _rates() -> list[Column]:
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        precision.alias("field_precision"),
        recall.alias("field_recall"),
        f1(precision, recall).alias("field_f1"),
        ratio(F.col("exact_records"), F.col("record_denominator")).alias("exact_record_rate"),
        ratio(F.col("decision_correct"), F.col("cases")).alias("decision_accuracy"),
    ]


_SUMS = ["true_positive", "false_positive", "false_negative", "exact_records", "record_denominator", "decision_correct"]


def metrics(counts: DataFrame, by_case: bool = False) -> DataFrame:
    """Micro metrics: sums over cases first, then rates; with ``by_case`` a row per case and one of all (null)."""
    sums = [F.sum(c).alias(c) for c in _SUMS] + [F.count("*").alias("cases")]
    if by_case:
        total = counts.groupingSets([["case_id"], []], "case_id").agg(*sums)
        return total.select("case_id", *_SUMS, "cases", *_rates())
    return counts.agg(*sums).na.fill(0).select(*_SUMS, "cases", *_rates())


def gate(measured: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Add ``passed``: every named metric reaches its minimum; without minimums always."""
    unknown = sorted(set(minimums) - set(METRICS))
    if unknown:
        raise ValueError(f"no such metrics: {', '.join(unknown)}")
    for name, least in minimums.items():
        if isinstance(least, bool) or not isinstance(least, int | float) or not 0 <= least <= 1:
            raise ValueError(f"the minimum of {name} must be between 0 and 1")
    passed = F.lit(True)
    for name, least in minimums.items():
        passed &= F.col(name) >= F.lit(float(least))
    return measured.withColumn("passed", passed)


def decision_pivot(decisions: DataFrame) -> DataFrame:
    """Counts of expected by actual decision."""
    return decisions.groupBy("expected_decision").pivot("decision", ["accepted", "needs_review", "rejected"]).count().na.fill(0)


def duplicate_values(frame: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once."""
    return frame.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
