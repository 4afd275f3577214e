"""Document-level operators: text, pages, identity, upload checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Warnings, and the limits of an upload.
NO_PARAGRAPHS = "no paragraph text detected in Word document"
NO_PAGE_TEXT = "no text layer detected (scanned or image-only PDF?)"
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_NAME = 180


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, para_index, text``: stripped paragraphs, numbered from 1 over all of them, blank ones left out."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("n", "raw"))
    return each.select("doc_id", (F.col("n") + 1).cast("long").alias("para_index"), strip(F.col("raw")).alias("text")).where("text <> ''")


def text_summary(docs: DataFrame, found: DataFrame, warning: str = NO_PARAGRAPHS) -> DataFrame:
    """Paragraphs of each document, and a warning where there is none."""
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))
    joined = docs.select("doc_id").join(counted, "doc_id", "left").withColumn("n_paragraphs", F.coalesce("n_paragraphs", F.lit(0).cast("long")))
    return joined.withColumn("warning", F.when(F.col("n_paragraphs") == 0, F.lit(warning)))


def full_text(found: DataFrame) -> DataFrame:
    """Each document's paragraphs as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("para_index", "text")))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def checked_page(page: object) -> int | None:
    """A 1-based page number, or null for all pages; anything else raises."""
    if page is None:
        return None
    if isinstance(page, bool) or not isinstance(page, int) or page < 1:
        raise ValueError("page must be a whole number from 1")
    return page


def select_page(frame: DataFrame, page: int | None) -> DataFrame:
    """Rows of one page."""
    page = checked_page(page)
    return frame if page is None else frame.where(F.col("page") == page)


def page_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("doc_id").agg(F.max("page").alias("pages"))


def identity(contents: DataFrame) -> DataFrame:
    """``doc_id, sha256, bytes`` of ``doc_id, content``; the content goes no further."""
    return contents.select("doc_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def upload_checks(uploads: DataFrame, mark: str = "%PDF-", within: int = 1024) -> DataFrame:
    """File name, whether the content looks like what the name says, and whether it is small enough.

    A Word document begins with ``PK``, anything else has ``mark`` near its start.  A
    name of more than ``MAX_NAME`` characters keeps the first 160 of its stem, and its suffix.
    """
    keys = [c for c in uploads.columns if c not in ("name", "content")]
    start = F.decode(F.substring("content", 1, within), "ISO-8859-1")
    name = F.regexp_extract("name", r"([^/?#]*)(?:[?#].*)?$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    short = F.concat(F.substring(F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", ""), 1, 160), suffix)
    return uploads.select(
        *keys,
        F.when(F.length(name) > MAX_NAME, short).otherwise(name).alias("filename"),
        F.when(suffix == ".docx", F.startswith(start, F.lit("PK"))).otherwise(start.contains(mark)).alias("signature_ok"),
        (F.octet_length("content") <= MAX_UPLOAD_BYTES).alias("size_ok"),
    )
