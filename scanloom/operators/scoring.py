"""Scores and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.dims import severity_dim

SCORE_NAMES = ("overall", "security", "quality", "maintenance")


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_up(c: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(c + 0.5)


def two_places(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def grade_of(overall: Column) -> Column:
    return F.when(overall >= 90, "A").when(overall >= 75, "B").when(overall >= 60, "C").when(overall >= 40, "D").otherwise("F")


def overall_of(security: Column, quality: Column, maintenance: Column) -> Column:
    return half_up(security * 0.5 + quality * 0.3 + maintenance * 0.2).cast("int")


def security_scores(skills: DataFrame, findings: DataFrame) -> DataFrame:
    """(skill_id, security): 100 less three times the summed weights, from 0 to 100; 100 without findings."""
    dim = F.broadcast(severity_dim(findings.sparkSession).select("severity", F.col("weight").alias("w")))
    weights = findings.select("skill_id", "severity").join(dim, "severity").groupBy("skill_id").agg(F.sum("w").alias("w"))
    score = clamp(100 - 3 * F.coalesce("w", F.lit(0))).cast("int")
    return skills.select("skill_id").join(weights, "skill_id", "left").select("skill_id", score.alias("security"))


def quality_of(m: dict[str, Column] | None = None) -> Column:
    """The quality score from metric columns: code_complexity, documentation_score, test_coverage and the rest."""
    c = {k: F.col(k) for k in "code_complexity documentation_score test_coverage outdated_dependencies has_readme has_license has_tests has_types has_source".split()} | (m or {})
    points = lambda flag, n: F.when(flag, n).otherwise(0)
    testing = points(c["has_tests"], 5) + F.coalesce(F.least(F.lit(10.0), c["test_coverage"] / 10), F.lit(0.0)) + points(c["has_types"], 5)
    code = F.when(F.coalesce(c["has_source"], F.lit(True)), testing).otherwise(20)
    total = 50 + F.greatest(F.lit(0.0), 15 - c["code_complexity"]) + c["documentation_score"] * 10 + code
    total = total + points(c["has_readme"], 3) + points(c["has_license"], 2) - F.least(F.lit(10), c["outdated_dependencies"] * 2)
    return clamp(half_up(total)).cast("int")


def scores(skills: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """(skill_id, overall, security, quality, maintenance, grade): one row per skill."""
    rated = metrics.select("skill_id", quality_of().alias("quality"), clamp(half_up(F.col("maintenance_health"))).cast("int").alias("maintenance"))
    joined = security_scores(skills, findings).join(rated, "skill_id")
    overall = overall_of(F.col("security"), F.col("quality"), F.col("maintenance"))
    return joined.withColumn("overall", overall).select("skill_id", *SCORE_NAMES, grade_of(F.col("overall")).alias("grade"))
