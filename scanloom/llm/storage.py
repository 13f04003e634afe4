"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanloom.packaging import LOCAL_FOLDER, ready_for_python, shared_folder  # noqa: F401

_ROOTS: dict[str, list[str]] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Readies a session for Python on its executors: Arrow batches of bounded size, and this package at hand."""
    ready_for_python(spark)


class Stash:
    """Tables written by one operator run.

    A written table cuts the lineage as a checkpoint does: it survives the loss
    of any executor, and what follows reads it instead of computing it again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scanloom-{name}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{label}")

    def drop(self, label: str) -> None:
        """Removes a table that nothing reads any more."""
        _delete(self.spark, f"{self.root}/{label}")


def tables_held(spark: SparkSession) -> list[str]:
    """The folders of tables that operators have written in this application and not removed."""
    return list(_ROOTS.get(spark.sparkContext.applicationId, []))


def clear_tables(spark: SparkSession, kept: list[str] = ()) -> None:
    """Removes the tables that operators wrote in this application, but for the folders ``kept``; lazy results that read them are lost.

    To be called when the results are written or no longer wanted.
    """
    for root in tables_held(spark):
        if root not in kept:
            _delete(spark, root)
    _ROOTS[spark.sparkContext.applicationId] = [r for r in tables_held(spark) if r in kept]


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
