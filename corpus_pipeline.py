"""A training-data pipeline out of five operators: filter, deduplicate, mix, encode.

Each stage works on all that its predecessor kept; what it decides takes effect
in what it returns.  All but the last return the columns of ``documents``; in
``run`` the mixture adds each row's place, which the last stage returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import exact_dedup, mixing, quality, queries, sentencepiece_spans, simhash, store


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score is at least one half; a null text is judged as an empty one."""
    return quality.accepted(docs, quality.train(docs, queries._table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts that are equal without white space; null counts as empty."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked fingerprints (within two bits), the one with the smallest id."""
    return simhash.keep_rows(docs)


#: Column of a row's place in the mixture.
PLACE = "mix_position"


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, place: str | None = None) -> DataFrame:
    """Put the rows in the order of a mixture with smoothed source weights; each row comes once.

    Files lose their order when they are read again, so ``run`` has each row's
    place written with it, as column ``place``.
    """
    return mixing.in_order(docs, place=place)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, byte spans and their digests of every document, with its place in the mixture.

    ``mix_position`` is the place that ``mix_sources`` has given a row; rows
    without one are numbered as they lie.  A null text counts as empty and has no
    ids; repeated rows come out as often as they come in.
    """
    place = F.col(PLACE) if PLACE in docs.columns else F.monotonically_increasing_id()
    placed = docs.select("doc_id", "text", place.alias("mix_position"))
    coded = sentencepiece_spans.encode(placed, queries.piece_model(), decode=True, carry=("mix_position",))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
        "begins",
        "ends",
        "mix_position",
    )


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A fitted classifier, XXH64 and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are written to shared storage and read again."""
    docs = queries._table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        more = {"place": PLACE} if stage is mix_sources else {}
        docs = store.materialise(stage(spark, docs, sf_dir, **more), f"pipeline-{name}")
    return docs
