"""Saved reports and leaderboards as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Skills (one row each) and the summary row of a saved JSON report; raises ValueError if it is none."""
    raw = spark.read.option("multiLine", True).json(path)
    if not {"skills", "summary"} <= set(raw.columns):
        raise ValueError("a report has skills and a summary")
    return raw.select(F.inline("skills")) if dict(raw.dtypes)["skills"].startswith("array<struct") else raw.select(F.explode("skills")), raw.select("summary.*")


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a leaderboard file: the fields of ``data``, else of ``entities``; entries without fields are dropped."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [F.col(c) for c in ("data", "entities") if c in raw.columns]
    if not lists:
        raise ValueError("a leaderboard has data or entities")
    rows = raw.select(F.explode(F.coalesce(*lists)).alias("entry"))
    return rows.filter("entry.fields IS NOT NULL").select("entry.fields.*")
