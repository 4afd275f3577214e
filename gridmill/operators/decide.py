"""Issue lists, decisions, summaries and fingerprints of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.profile import Profile, canonical_json
from .records import ISSUE, duplicate_of, issue, source_of

# Codes that reject a document.
FATAL = ("no_matching_table", "no_compatible_table", "insufficient_records")


def document_counts(documents: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row per document, documents without tables or records included, from the tables of ``table_flags``."""
    kinds = flagged.groupBy("doc_id").agg(
        F.count("*").alias("detected_tables"),
        F.count_if(F.col("kind").isin("compatible", "rejected")).alias("matched_tables"),
        F.count_if(F.col("kind") == "compatible").alias("compatible_tables"),
        F.count_if(F.col("kind") == "continued").alias("headerless_continuations"),
        F.sum("record_count").alias("records"),
        F.sum("accepted_count").alias("accepted_records"),
    )
    return documents.select("doc_id").distinct().join(kinds, "doc_id", "left").na.fill(0)


def document_issues(counts: DataFrame, profile: Profile) -> DataFrame:
    """Issues of whole documents, in order: no matching or compatible table, then too few records."""
    least = profile.table["min_records"]
    found = F.array(
        F.when(F.col("matched_tables") == 0, issue("error", "no_matching_table", "no table met the profile's header-match threshold")).when(
            F.col("compatible_tables") == 0, issue("error", "no_compatible_table", "matched tables were missing required columns")
        ),
        F.when(F.col("records") < least, issue("error", "insufficient_records", f"profile requires at least {least} record(s)")),
    )
    return counts.select("doc_id", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("n", "issue"))


def table_flags(issued: DataFrame, unique: DataFrame, flaws: bool = False) -> DataFrame:
    """Tables with ``record_count``, ``accepted_count`` and the one issue that depends on their rows: a matched table without records.

    With ``flaws`` also ``flaw_count``, the records that have issues of their own or repeat a key.
    """
    more = [F.count_if(F.col("flawed") | F.coalesce(F.col("first_of_key") < F.col("record_index"), F.lit(False))).alias("flaw_count")] if flaws else []
    used = unique.groupBy("doc_id", "table_seq").agg(F.count("*").alias("record_count"), F.count_if(F.col("status") == "accepted").alias("accepted_count"), *more)
    t = issued.join(used, ["doc_id", "table_seq"], "left").na.fill(0, ["record_count", "accepted_count"])
    empty = issue("warning", "empty_matched_table", "table matched the profile but contained no data records", source=source_of())
    no_rows = F.col("kind").isin("compatible", "continued") & (F.col("record_count") == 0)
    none = F.array().cast(f"array<{ISSUE}>")
    return t.withColumn("table_issues", F.concat("table_issues", F.when(no_rows, F.array(empty)).otherwise(none)))


def canonical_issue(value: Column) -> Column:
    """JSON without null context, keys in alphabetical order: equal issues have equal texts."""
    return F.to_json(value)


def _every_issue(documents: DataFrame, flagged: DataFrame, unique: DataFrame) -> DataFrame:
    """Issues of documents, tables and records with their order; those of a duplicate key hang on the document and on two records and come once."""
    numbered = lambda df, scope: df.select("doc_id", F.lit(scope).alias("scope"), "a", "b", "issue")
    whole = numbered(documents.select("doc_id", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"), "issue"), 0)
    of_tables = numbered(flagged.select("doc_id", F.col("table_seq").cast("long").alias("a"), F.posexplode("table_issues").alias("b", "issue")), 1)
    # a repeated key comes after the document's own issues, in the order of its records
    own = F.transform("issues", lambda i, b: F.struct(F.lit(2).alias("scope"), F.col("record_index").alias("a"), b.cast("long").alias("b"), i.alias("issue")))
    key = F.struct(F.lit(0).alias("scope"), F.lit(1).cast("long").alias("a"), F.col("record_index").alias("b"), F.col("duplicate").alias("issue"))
    listed = F.when(F.col("duplicate").isNotNull(), F.concat(F.array(key), own)).otherwise(own)
    flawed = F.col("flawed") if "flawed" in unique.columns else F.size("issues") > 0
    cells = unique.where(flawed | F.col("duplicate").isNotNull()).select("doc_id", F.inline(listed))
    return whole.unionByName(of_tables).unionByName(cells).withColumn("json", canonical_issue(F.col("issue")))


def all_issues(documents: DataFrame, flagged: DataFrame, unique: DataFrame) -> DataFrame:
    """Every distinct issue of a document in order: the document's, its tables', its records'.

    Of issues with the same JSON the first stays.
    """
    order = Window.partitionBy("doc_id", "json").orderBy("scope", "a", "b")
    # both windows take rows as they lie, so issues are shuffled once
    every = _every_issue(documents, flagged, unique).repartition("doc_id")
    first = every.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("scope", "a", "b"))
    return first.select("doc_id", position.alias("issue_number"), "scope", "issue", "json")


def issue_totals(documents: DataFrame, flagged: DataFrame, unique: DataFrame) -> DataFrame:
    """``doc_id, issues, fatal``: the number of distinct issues, and whether one rejects the document."""
    return distinct_issues(documents, flagged, unique).groupBy("doc_id").agg(F.count("*").alias("issues"), F.max(F.col("code").isin(*FATAL)).alias("fatal"))


def distinct_issues(documents: DataFrame, flagged: DataFrame, unique: DataFrame) -> DataFrame:
    """``doc_id, scope, code`` of every distinct issue of a document, without its number and text."""
    # what is grouped by document later on stays where it is
    every = _every_issue(documents, flagged, unique).select("doc_id", "scope", F.col("issue.code").alias("code"), "json").repartition("doc_id")
    return every.groupBy("doc_id", "json", "code").agg(F.min("scope").alias("scope")).select("doc_id", "scope", "code")


def record_issues(unique: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Records with all issues that hang on them, duplicate keys of later records included, which are sought unless ``unique`` has them as ``later``."""
    if "later" in unique.columns:
        repeats = F.transform("later", lambda i: duplicate_of(profile, F.col("record_index"), i))
        return _with_repeats(unique.withColumn("repeats", repeats)).drop("later")
    later = unique.where(F.col("duplicate").isNotNull()).groupBy("doc_id", F.col("first_of_key").alias("record_index")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("record_index", "duplicate"))), lambda r: r["duplicate"]).alias("repeats")
    )
    return _with_repeats(unique.join(later, ["doc_id", "record_index"], "left"))


def _with_repeats(joined: DataFrame) -> DataFrame:
    none = F.array().cast(f"array<{ISSUE}>")
    own = F.when(F.col("duplicate").isNotNull(), F.array("duplicate")).otherwise(none)
    others = F.coalesce("repeats", none)
    return joined.withColumn("issues", F.concat("issues", own, others)).drop("repeats", "duplicate", "first_of_key", "flawed")


def decisions(counts: DataFrame, totals: DataFrame, *more: str) -> DataFrame:
    """Decision and summary of every document, and ``more`` columns of ``totals``."""
    d = counts.join(totals, "doc_id", "left")
    decision = F.when(F.coalesce("fatal", F.lit(False)), F.lit("rejected")).when(F.coalesce("issues", F.lit(0)) > 0, F.lit("needs_review")).otherwise(F.lit("accepted"))
    return d.select(
        "doc_id",
        decision.alias("decision"),
        "detected_tables",
        "matched_tables",
        "compatible_tables",
        "headerless_continuations",
        "records",
        "accepted_records",
        F.coalesce("issues", F.lit(0)).alias("issues"),
        *more,
    )


def verdicts(documents: DataFrame, flagged: DataFrame, profile: Profile) -> DataFrame:
    """``doc_id, decision`` as in ``decisions``, from tables with ``flaw_count``.

    Issues need not be told apart or counted for that: those of whole documents are
    those that reject, and any other calls for review.
    """
    kinds = flagged.groupBy("doc_id").agg(
        F.count_if(F.col("kind").isin("compatible", "rejected")).alias("matched_tables"),
        F.count_if(F.col("kind") == "compatible").alias("compatible_tables"),
        F.sum("record_count").alias("records"),
        F.count_if((F.size("table_issues") > 0) | (F.coalesce("flaw_count", F.lit(0)) > 0)).alias("flawed_tables"),
    )
    d = documents.select("doc_id").distinct().join(kinds, "doc_id", "left").na.fill(0)
    rejected = (F.col("matched_tables") == 0) | (F.col("compatible_tables") == 0) | (F.col("records") < profile.table["min_records"])
    return d.select("doc_id", F.when(rejected, F.lit("rejected")).when(F.col("flawed_tables") > 0, F.lit("needs_review")).otherwise(F.lit("accepted")).alias("decision"))


def fingerprint(document_sha256: Column, profile: Profile, engine: str, engine_version: str, version_key: str, version: str, schema: str = "1.0") -> Column:
    """SHA-256 of the sorted, compact JSON of what went into an extraction."""
    basis = {"document_sha256": "\x00", "profile_sha256": profile.sha256, version_key: version, "engine": {"name": engine, "version": engine_version}, "result_schema_version": schema}
    before, after = canonical_json(basis).replace("\\u0000", "\x00").split("\x00")
    return F.sha2(F.concat(F.lit(before), document_sha256, F.lit(after)), 256)
