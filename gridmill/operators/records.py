"""Data rows to typed records with their issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.convert import codes, completed, is_plain, message, plain
from ..functions.text import normalize_header, strip
from ..plans.profile import Profile
from .match import alias_map, foreign_letters
from .tables import TABLE

#: An issue: context that is null is left out of its JSON, whose keys are in alphabetical order.
ISSUE = "struct<code:string,field:string,message:string,records:array<bigint>,severity:string,source:struct<bbox:array<double>,column:int,columns:array<int>,page:int,row:int,table_index:int>>"


def issue(severity: str, code: Column | str, text: Column | str, field: Column | str | None = None, source: Column | None = None, records: Column | None = None) -> Column:
    as_text = lambda v: F.lit(v) if isinstance(v, str) else v
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        as_text(code).alias("code"),
        (as_text(field) if field is not None else none("string")).alias("field"),
        as_text(text).alias("message"),
        (records if records is not None else none("array<bigint>")).alias("records"),
        F.lit(severity).alias("severity"),
        (source if source is not None else none("struct<bbox:array<double>,column:int,columns:array<int>,page:int,row:int,table_index:int>")).alias("source"),
    ).cast(ISSUE)


def source_of(row: Column | None = None, column: Column | None = None, columns: Column | None = None) -> Column:
    """Where an issue lies: the table, and the row and column if it is about a cell."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.col("bbox").cast("array<double>").alias("bbox"),
        (column if column is not None else none("int")).cast("int").alias("column"),
        (columns if columns is not None else none("array<int>")).alias("columns"),
        F.col("page").cast("int").alias("page"),
        (row if row is not None else none("int")).cast("int").alias("row"),
        F.col("table_index").cast("int").alias("table_index"),
    )


def data_rows(matched: DataFrame, rows: DataFrame, profile: Profile, laid: bool = False) -> DataFrame:
    """Rows below the header (all rows of a continued table) that are neither blank nor the header again.

    ``laid`` tells that all rows of a document lie in one partition already.
    """
    usable = matched.where(F.col("kind").isin("compatible", "continued"))
    if "table_issues" in usable.columns:
        # all that rows need of their table's issues
        usable = usable.select(*TABLE, "page", "table_index", "bbox", "header_row", "header", "mapping", (F.size("table_issues") > 0).alias("table_flagged"))
    # once for each table instead of each row
    usable = usable.withColumn("mapped", F.filter(F.col("mapping"), lambda x: x.isNotNull()))
    # both sides by document: the joins and windows above keep that partitioning
    joined = (rows if laid else rows.repartition("doc_id")).join(usable.repartition("doc_id"), TABLE).where(F.col("header_row").isNull() | (F.col("row") > F.col("header_row")))
    # a visible ASCII character in the first cell tells most rows from blank ones
    joined = joined.where(F.coalesce(F.get("cells", F.lit(0)).rlike("[!-~]"), F.lit(False)) | F.exists("cells", lambda c: strip(c) != ""))
    names, mapped = F.array(*[F.lit(f) for f in profile.fields]), F.col("mapped")
    lookup = alias_map(profile)
    # stops at the first mapped cell that does not name its field, which for data is the first one
    same = F.forall(
        F.sequence(F.lit(0), F.lit(len(profile.columns) - 1)),
        lambda i: F.get(F.col("mapping"), i).isNull()
        | F.coalesce(F.element_at(lookup, normalize_header(F.get(F.col("cells"), F.get(F.col("mapping"), i)))) == F.get(names, i), F.lit(False)),
    )
    extras = F.forall(
        F.transform(F.col("cells"), lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
        lambda x: F.array_contains(mapped, x["i"].cast("int"))
        | (strip(x["c"]) == "")
        | F.coalesce(normalize_header(x["c"]) == normalize_header(F.get(F.col("header"), x["i"])), F.lit(False)),
    )
    other = foreign_letters(profile)
    foreign = F.lit(False)
    for i in range(len(profile.columns)):
        foreign |= F.coalesce(F.get("cells", F.get("mapping", F.lit(i))).rlike(other), F.lit(False))
    # only rows whose mapped cells all name a field can repeat the header, so others skip the rest
    repeated = ~foreign & (F.size(mapped) > 0) & same & extras
    # one expression, which Spark does not take apart: the header itself, left out above, would go through all of it
    below = F.col("header_row").isNull() | (F.col("row") > F.col("header_row"))
    return joined.where(F.when(below, ~repeated).otherwise(F.lit(False)))


def table_issues(matched: DataFrame, profile: Profile) -> DataFrame:
    """Add ``table_issues`` as far as they do not depend on a table's rows, and ``unmapped_headers``."""
    at = source_of()
    mapped = F.filter(F.col("mapping"), lambda x: x.isNotNull())
    unmapped = F.filter(
        F.transform(F.col("header"), lambda h, i: F.struct(i.cast("int").alias("column"), h.alias("header"))),
        lambda x: ~F.array_contains(mapped, x["column"]) & (strip(x["header"]) != ""),
    )
    m = matched.withColumn("unmapped_headers", F.when(F.col("kind").isin("compatible", "continued"), unmapped))
    position = F.create_map(*[x for i, name in enumerate(profile.fields) for x in (F.lit(name), F.lit(i))])
    doubled = F.transform(
        F.array_distinct(F.transform("doubles", lambda d: d["field"])),
        lambda name: issue(
            "error",
            "duplicate_mapped_column",
            F.concat(F.lit("multiple source columns map to "), name),
            name,
            source_of(
                columns=F.concat(
                    F.array(F.get(F.col("mapping"), F.element_at(position, name))),
                    F.transform(F.filter(F.col("doubles"), lambda d: d["field"] == name), lambda d: d["column"]),
                )
            ),
        ),
    )
    none = F.array().cast(f"array<{ISSUE}>")
    one = lambda condition, value: F.when(condition, F.array(value)).otherwise(none)
    parts = F.concat(
        one(F.col("kind") == "continued", issue("warning", "headerless_continuation", "adjacent same-width table was extracted using the prior page's column mapping", source=at)),
        F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: issue("warning", "extractor_warning", w, source=at)),
        one(F.coalesce(F.col("has_merged_cells"), F.lit(False)), issue("warning", "merged_cells", "source table contains merged cells", source=at)),
        doubled,
        *([] if profile.table["allow_extra_columns"] else [one(F.size("unmapped_headers") > 0, issue("error", "extra_columns", "source table contains columns not allowed by the profile", source=at))]),
    )
    partial = issue("warning", "partial_profile_match", "table matched some profile headers but not the configured threshold", source=at)
    lacking = issue("error", "missing_required_columns", F.concat(F.lit("required columns were not found: "), F.array_join("missing", ", ")), source=at)
    return m.withColumn(
        "table_issues",
        F.when(F.col("kind") == "unmatched", one(F.col("score") > 0, partial)).when(F.col("kind") == "rejected", F.array(lacking)).otherwise(parts),
    )


#: What there is of each profile column, as columns of its own: ``raw0, value0, codes0, ..., raw1, ...``.
_PARTS = ("column", "raw", "value", "codes", "has_evidence", "bbox")


def typed(data: DataFrame, profile: Profile, jvm: bool = False) -> DataFrame:
    """Add ``_PARTS`` of each profile column, in profile order."""
    at = [F.get(F.col("mapping"), F.lit(i)) for i in range(len(profile.columns))]
    # raw texts, then plain values, then the rest: each is read several times by the next
    out = data.select("*", *[_raw(profile, i).alias(f"__raw{i}") for i in range(len(at))])
    out = out.select("*", *[plain(F.col(f"__raw{i}"), f).alias(f"__plain{i}") for i, f in enumerate(profile.columns)])
    if jvm:
        out = out.select("*", *[completed(F.col(f"__raw{i}"), F.col(f"__plain{i}"), f, jvm).alias(f"__full{i}") for i, f in enumerate(profile.columns)])
    parts = []
    for i, f in enumerate(profile.columns):
        raw = F.col(f"__raw{i}")
        value = F.col(f"__full{i}") if jvm else completed(raw, F.col(f"__plain{i}"), f)
        parts += [
            at[i].alias(f"column{i}"),
            F.coalesce(raw, F.lit("")).alias(f"raw{i}"),
            F.when(raw != "", F.coalesce(value, raw)).alias(f"value{i}"),
            F.when(raw.isNotNull(), codes(raw, value, f, jvm)).otherwise(F.array().cast("array<string>")).alias(f"codes{i}"),
            F.coalesce(at[i] < F.size("cells"), F.lit(False)).alias(f"has_evidence{i}"),
            (F.get(F.col("boxes"), at[i]) if "boxes" in data.columns else F.lit(None).cast("array<double>")).alias(f"bbox{i}"),
        ]
    return out.select(*[F.col(f"`{c}`") for c in data.columns], *parts)


def _raw(profile: Profile, i: int) -> Column:
    """Stripped text of profile column ``i``; null where it has no source column."""
    at = F.get(F.col("mapping"), F.lit(i))
    return F.when(at.isNotNull(), strip(F.coalesce(F.get(F.col("cells"), at), F.lit(""))))


def _with_keys(frame: DataFrame, values: list[Column]) -> DataFrame:
    """Add ``__whole`` (no part of the key is null), and the first record and number of records of each key."""
    whole = F.lit(True)
    for v in values:
        whole &= v.isNotNull()
    keyed = frame.select("*", whole.alias("__whole"), F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)]).alias("__key"))
    same = Window.partitionBy("doc_id", "__whole", "__key")
    return keyed.select(*frame.columns, "__whole", F.min("record_index").over(same).alias("__first"), F.count("*").over(same).alias("__times"))


_KEYS = ["__whole", "__first", "__times"]


def _cell_issues(profile: Profile) -> Column:
    texts = F.create_map(*[x for f in profile.columns for code in ("blank_required_value", "invalid_type", "pattern_mismatch", "value_not_allowed", "below_minimum", "above_maximum") for x in (F.lit(f"{f.name} {code}"), F.lit(message(code, f)))])
    listed = F.flatten(
        F.transform(
            "fields",
            lambda f: F.transform(
                f["codes"],
                lambda code: issue("error", code, F.element_at(texts, F.concat_ws(" ", f["name"], code)), f["name"], source_of(F.col("row"), f["column"])),
            ),
        )
    )
    return F.when(_flawed(profile), listed).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _flawed(profile: Profile) -> Column:
    """Whether a record has issues of its own."""
    return sum((F.size(f"codes{i}") for i in range(len(profile.columns))), F.lit(0)) > 0


def _nested(values: DataFrame, profile: Profile) -> DataFrame:
    """``values`` with ``fields``, an array of structs of ``name`` and ``_PARTS``."""
    parts = [F.struct(F.lit(f.name).alias("name"), *[F.col(f"{part}{i}").alias(part) for part in _PARTS if f"{part}{i}" in values.columns]) for i, f in enumerate(profile.columns)]
    return values.withColumn("fields", F.array(*parts))


def narrowed(values: DataFrame, profile: Profile, parts: tuple[str, ...]) -> DataFrame:
    """``values`` with these of ``_PARTS`` only, and without what is unmapped."""
    return values.drop("unmapped_values", *[f"{part}{i}" for part in _PARTS if part not in parts for i in range(len(profile.columns))])


def _unnested(values: DataFrame, profile: Profile) -> list[str]:
    """Columns of ``values`` that are not of one profile column."""
    single = {f"{part}{i}" for part in _PARTS for i in range(len(profile.columns))}
    return [c for c in values.columns if c not in single]


def viewed(kept: DataFrame, profile: Profile) -> DataFrame:
    """Records as ``unique_check`` gives them, from what is kept of them: ``record_values`` with ``status`` and ``first_of_key``."""
    names = [c for c in _unnested(kept, profile) if c not in ("status", "first_of_key")]
    found = _nested(kept, profile).withColumn("issues", _cell_issues(profile))
    return found.select(*names, "fields", "issues", _duplicate(profile).alias("duplicate"), "first_of_key", "status")


def extract_records(issued: DataFrame, rows: DataFrame, profile: Profile) -> DataFrame:
    """One row per record of the tables of ``table_issues``: ``record_index`` over the document, its fields, unmapped values and own issues.

    ``table_flagged`` tells whether the record's table has issues, which send the
    record to review without being its own.
    """
    values = record_values(issued, rows, profile)
    names = [c for c in _unnested(values, profile) if c not in ("flawed", "unmapped_values", "table_flagged", *_KEYS)]
    return _nested(values, profile).select(*names, "fields", "unmapped_values", _cell_issues(profile).alias("issues"), "table_flagged", *[c for c in _KEYS if c in values.columns])


def record_values(issued: DataFrame, rows: DataFrame, profile: Profile, jvm: bool = False, laid: bool = False, later: DataFrame | None = None) -> DataFrame:
    """Records with one column for each part of a field, and ``flawed`` (there are issues of its own).

    So nested values need not be written, and parts that nobody reads are never made.
    ``jvm`` is that of ``convert.completed``, ``laid`` that of ``data_rows``.  Where the
    records that repeat a record's key are known (``doc_id, record_index, later``),
    each record gets its ``later``.
    """
    order = Window.partitionBy("doc_id").orderBy("table_seq", "row")
    # numbered before conversion: an Arrow function in the plan hides how the rows are partitioned
    numbered = data_rows(issued, rows, profile, laid).withColumn("record_index", (F.row_number().over(order) - 1).cast("long"))
    keys = [(i, f) for i, f in enumerate(profile.columns) if f.name in profile.table["unique_by"]]
    if keys and all(is_plain(f, jvm) for _, f in keys):
        # keys that need no Arrow function are compared here, where rows lie by document and are narrow
        texts = numbered.select("*", *[_raw(profile, i).alias(f"__text{i}") for i, _ in keys])
        numbered = _with_keys(texts, [F.when(F.col(f"__text{i}") != "", F.coalesce(completed(F.col(f"__text{i}"), plain(F.col(f"__text{i}"), f), f, jvm), F.col(f"__text{i}"))) for i, f in keys]).select(*numbered.columns, *_KEYS)
    if later is not None:
        # rows are narrow and lie by document here
        numbered = numbered.join(later.repartition("doc_id"), ["doc_id", "record_index"], "left")
    data = typed(numbered, profile, jvm)
    mapped = F.col("mapped")
    # the first columns, as many as the row has, are all mapped
    covered = (F.array_max("mapped") + 1 == F.size("mapped")) & (F.size("cells") <= F.size("mapped"))
    rest = F.filter(
        F.transform(F.col("cells"), lambda c, i: F.struct(i.cast("int").alias("column"), F.coalesce(F.get(F.col("header"), i), F.lit("")).alias("header"), strip(c).alias("raw"))),
        lambda x: ~F.array_contains(mapped, x["column"]) & ((strip(x["header"]) != "") | (x["raw"] != "")),
    )
    return data.select(
        *TABLE,
        "page",
        "table_index",
        "bbox",
        "row",
        "record_index",
        *[f"{part}{i}" for i in range(len(profile.columns)) for part in _PARTS],
        F.when(F.coalesce(covered, F.lit(False)), F.array().cast("array<struct<column:int,header:string,raw:string>>")).otherwise(rest).alias("unmapped_values"),
        _flawed(profile).alias("flawed"),
        "table_flagged",
        *[c for c in ("later", *_KEYS) if c in numbered.columns],
    )


def duplicate_of(profile: Profile, first: Column, repeat: Column) -> Column:
    """The issue that names the first record of a key and one that repeats it."""
    return issue("error", "duplicate_record_key", f"duplicate record key for {', '.join(profile.table['unique_by'])}", records=F.array(first, repeat))


def _duplicate(profile: Profile) -> Column:
    """The issue of a record whose key was met before."""
    return F.when(F.col("first_of_key") < F.col("record_index"), duplicate_of(profile, F.col("first_of_key"), F.col("record_index")))


def unique_check(records: DataFrame, profile: Profile) -> DataFrame:
    """Add ``duplicate``: for a record whose key was met before, the issue that names both; ``first_of_key``, and ``status``.

    Keys with a null part are not held against others.  Both records of a
    repeated key need review, as do those with issues of their own or their table's.
    """
    keys = profile.table["unique_by"]
    review = (F.col("flawed") if "flawed" in records.columns else F.size("issues") > 0) | F.col("table_flagged")
    status = lambda bad: F.when(bad, F.lit("needs_review")).otherwise(F.lit("accepted")).alias("status")
    if not keys:
        return records.select("*", F.lit(None).cast(ISSUE).alias("duplicate"), F.lit(None).cast("long").alias("first_of_key"), status(review))
    at = {name: i for i, name in enumerate(profile.fields)}
    # what extract_records has found, or could not without an Arrow function
    value = lambda k: F.col("fields")[at[k]]["value"] if "fields" in records.columns else F.col(f"value{at[k]}")
    keyed = records if "__first" in records.columns else _with_keys(records, [value(k) for k in keys])
    keyed = keyed.withColumn("first_of_key", F.when(F.col("__whole"), F.col("__first")))
    return keyed.select(
        *[c for c in records.columns if c not in _KEYS],
        _duplicate(profile).alias("duplicate"),
        "first_of_key",
        status(review | (F.col("__whole") & (F.col("__times") > 1))),
    )
