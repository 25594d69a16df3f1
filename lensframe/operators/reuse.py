"""Incremental reuse: compute only what is not stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_key(rows: DataFrame, columns: list[str], config: str) -> DataFrame:
    """SHA-1 over the configuration's name and all the named columns."""
    return rows.withColumn("key", F.sha1(F.concat_ws("|", F.lit(config), *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))))


def reuse_results(inputs: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``inputs`` (column key): those in the store, and the missing
    ones computed and appended to it, each key once."""
    spark = inputs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    todo = inputs.dropDuplicates(["key"])
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        todo = todo.join(spark.read.parquet(store).select("key").distinct(), "key", "left_anti")
    compute(todo).write.mode("append").parquet(store)
    return spark.read.parquet(store).join(inputs.select("key").distinct(), "key", "left_semi")
