"""Summaries across skills: totals, matrices, best and worst, top k, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.dims import SEVERITIES
from scanloom.operators.scoring import half_up

NAMES = [s for s, *_ in SEVERITIES]


def severity_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(NAMES):
        out = F.when(c == name, i).otherwise(out)
    return out


def counted(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def run_summary(scores: DataFrame, findings: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: skills, mean score, findings by severity, blocked and certified skills; zeros for none."""
    of_scores = scores.agg(
        F.count("*").alias("total_skills"),
        F.coalesce(half_up(F.avg("overall")), F.lit(0)).cast("int").alias("average_score"),
        counted(F.col("grade").isin("A", "B")).alias("certified_skills"),
    )
    of_findings = findings.agg(*[counted(F.col("severity") == s).alias(f"{s}_findings") for s in NAMES[:4]], F.count("*").alias("total_findings"))
    of_policy = violations.filter("action = 'block'").agg(F.countDistinct("skill_id").alias("blocked_skills"))
    return of_scores.crossJoin(F.broadcast(of_findings)).crossJoin(F.broadcast(of_policy))  # single rows


def matrix_cells(findings: DataFrame, with_info: bool = False) -> DataFrame:
    """(rule_key, skill_id, worst, n): worst severity and count; ``info`` counts, but is no worst unless asked for."""
    rank = severity_rank(F.col("severity"))
    worst = F.min(rank if with_info else F.when(F.col("severity") != "info", rank))
    cells = findings.groupBy(F.coalesce("owasp_id", "rule").alias("rule_key"), "skill_id").agg(worst.alias("r"), F.count("*").alias("n"))
    return cells.select("rule_key", "skill_id", F.coalesce(F.try_element_at(F.array(*map(F.lit, NAMES)), F.col("r") + 1), F.lit("pass")).alias("worst"), "n")


def dense_matrix(findings: DataFrame, skills: DataFrame) -> DataFrame:
    """A cell for each rule that occurs and each skill; missing ones pass with 0.

    The rules that occur are as many as the registry has at most.
    """
    cells = matrix_cells(findings)
    keys = cells.select("rule_key").distinct()
    grid = skills.select("skill_id").distinct().join(F.broadcast(keys), how="cross")
    return grid.join(cells, ["rule_key", "skill_id"], "left").select("rule_key", "skill_id", F.coalesce("worst", F.lit("pass")).alias("worst"), F.coalesce("n", F.lit(0)).alias("n"))


def rule_columns(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Skills by rules, with counts: a pivot over given keys."""
    return findings.withColumn("rule_key", F.coalesce("owasp_id", "rule")).groupBy("skill_id").pivot("rule_key", keys).count().na.fill(0)


def rule_number(key: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_replace(key, "[^0-9]", ""), F.lit("999999")).cast("int"), F.lit(0))


def best_and_worst(scores: DataFrame) -> DataFrame:
    """One row: the skills of highest and lowest overall score; ties go to the first id."""
    return scores.agg(
        F.min(F.struct(F.negative("overall").alias("o"), "skill_id"))["skill_id"].alias("best"),
        F.min(F.struct("overall", "skill_id"))["skill_id"].alias("worst"),
    )


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """The first k findings of each skill by severity, then order."""
    order = W.partitionBy("skill_id").orderBy("severity_rank", "file_ord", "rel_path", "rule", "pattern_ord", "at")
    return findings.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def worst_skills(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k skills with most critical findings, of those that have any."""
    return findings.filter("severity = 'critical'").groupBy("skill_id").agg(F.count("*").alias("critical")).orderBy(F.desc("critical"), "skill_id").limit(k)


def platform_rollup(skills: DataFrame) -> DataFrame:
    """Skills by platform and root, unknown platforms last."""
    root = F.regexp_replace("skill_dir", "/[^/]*$", "")
    return skills.groupBy("platform", root.alias("root")).agg(F.count("*").alias("skills")).orderBy(F.asc_nulls_last("platform"), "root")


def web3_rollup(detected: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: how many skills are about web3, and how many critical findings these have."""
    critical = findings.filter("severity = 'critical'").groupBy("skill_id").agg(F.count("*").alias("critical"))
    rows = detected.filter("is_web3").select("skill_id").join(critical, "skill_id", "left")
    return rows.agg(F.count("*").alias("web3_skills"), F.coalesce(F.sum("critical"), F.lit(0)).alias("web3_critical"))


# ---- leaderboard


def relative_time(at: Column, as_of: Column) -> Column:
    """How long ago a time was, in days, months of 30 days, or years of 12 months; ``unknown`` if it is null."""
    at, as_of = at.cast("timestamp"), as_of.cast("timestamp")
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / 86_400_000_000)
    months = F.floor(days / 30)
    years = F.floor(months / 12)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    told = F.when(days < 1, "today").when(days < 30, ago(days, "day")).when(months < 12, ago(months, "month")).otherwise(ago(years, "year"))
    return F.when(at.isNull(), "unknown").otherwise(told)


def leaderboard_totals(entries: DataFrame) -> DataFrame:
    """One row over all entries: counts, sums, the rounded mean score, and the latest valid scan."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return entries.agg(
        F.count("*").alias("skills"),
        *[total(f"{s}_findings").alias(s) for s in NAMES[:4]],
        F.coalesce(half_up(F.avg("overall_score")), F.lit(0)).cast("int").alias("average_score"),
        total("install_count").alias("installs"),
        counted(F.col("is_web3")).alias("web3"),
        F.max(F.try_to_timestamp("last_scanned_at")).alias("last_scan"),
        counted(F.col("grade").isin("D", "F")).alias("failing"),
        F.coalesce(half_up(F.avg(F.col("grade").isin("D", "F").cast("double")) * 100), F.lit(0)).cast("int").alias("failing_percent"),
    )


def grade_histogram(entries: DataFrame) -> DataFrame:
    """Entries by grade; blank grades count as ``?``."""
    grade = F.when(F.coalesce(F.trim("grade"), F.lit("")) == "", "?").otherwise(F.col("grade"))
    return entries.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


def risk_histogram(entries: DataFrame) -> DataFrame:
    """Entries with critical, high or medium findings, by their top risk; most first."""
    bad = F.coalesce("critical_findings", F.lit(0)) + F.coalesce("high_findings", F.lit(0)) + F.coalesce("medium_findings", F.lit(0)) > 0
    rows = entries.filter(bad & (F.coalesce("top_finding_owasp", F.lit("")) != ""))
    return rows.groupBy(F.col("top_finding_owasp").alias("owasp_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owasp_id")


#: Sort keys of the leaderboard and their columns.
SORTS = {"name": "skill_name", "score": "overall_score", "grade": "grade", "critical": "critical_findings", "installs": "install_count", "scanned": "last_scanned_at", "trending": "trending_rank"}
PAGE = 24


def leaderboard_page(
    entries: DataFrame, grade: str | None = None, state: str | None = None, owasp: str | None = None, text: str = "", sort: str = "score", ascending: bool = False, page: int = 0
) -> DataFrame:
    """A page of 24 entries after filters; missing values come last when ascending, first when descending."""
    rows = entries
    if grade:
        rows = rows.filter(F.col("grade") == grade)
    risky = F.coalesce("critical_findings", F.lit(0)) + F.coalesce("high_findings", F.lit(0)) > 0
    if state in ("vulnerable", "clean"):
        rows = rows.filter(risky if state == "vulnerable" else ~risky)
    if owasp:
        rows = rows.filter(F.col("top_finding_owasp") == owasp)
    if text.strip():
        corpus = F.lower(F.concat_ws(" ", "owner", "repo", "skill_path", "skill_name", "top_finding_rule", "top_finding_owasp"))
        rows = rows.filter(corpus.contains(text.strip().lower()))
    key = F.col(SORTS[sort])
    return rows.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_first(), "owner", "repo", "skill_path").offset(page * PAGE).limit(PAGE)
