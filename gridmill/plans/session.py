"""A session with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Windows, groupings and joins by (document, ...) keep the partitioning by document.  Methods above 8,000 bytes
#: are never compiled by the JVM, so such stages go without whole-stage code.  Shuffles begin with many
#: partitions, which are put together up to a size, so that a task does not grow with the input.  Sets are
#: collected over very many small groups (tables), which a sort serves better than a map of objects.  Arrays
#: are not made twice, once to see that they are not empty.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "gridmill", **more: str) -> SparkSession:
    """Get or make a session; ``more`` are further settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set on a running session what may be set there."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
