"""Documents dropped into a folder, extracted as they arrive.

Documents do not depend on one another, so every batch is one extraction; a
file whose content was seen before (in an earlier batch too) is left out, by the
hashes in the written output.  No file is left out for its age.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import store
from ..plans.extraction import extract
from ..plans.profile import Profile, load
from ..sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Parsed documents of a drop folder as a stream, every file whatever its modification time."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d").option("recursiveFileLookup", "true").load(folder)
    return files.parse_files(raw)


def _new(batch: DataFrame, number: int, output: str) -> DataFrame:
    """The documents of a batch, each content once, that no other batch has written."""
    first = Window.partitionBy("sha256").orderBy("doc_id")
    once = batch.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    try:
        written = batch.sparkSession.read.parquet(f"{output}/documents")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return once  # nothing is written yet
    return once.join(written.where(F.col("batch") != number).select("sha256"), "sha256", "left_anti").select(batch.columns)


def run(spark: SparkSession, folder: str, profile: str | dict | Profile, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Extract arrivals and append decisions and records below ``output``, in a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so
    nothing is written twice.
    """
    checked = load(profile)

    def each(batch: DataFrame, number: int) -> None:
        # written before this batch's own folder is
        place = store.new_path(batch.sparkSession, "arrivals")
        batch = store.materialise(_new(batch, number, output), "arrivals", place)
        found = extract(batch.select("doc_id"), *files.tables_and_rows(batch), checked)
        found.documents.join(batch.select("doc_id", "sha256", "error"), "doc_id").write.mode("overwrite").parquet(f"{output}/documents/batch={number}")
        found.wide.write.mode("overwrite").parquet(f"{output}/records/batch={number}")
        found.release()
        store.remove(batch.sparkSession, place)

    writer = arrivals(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
