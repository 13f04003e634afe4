"""Policies: rules with conditions, evaluated for all skills at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.operators.conditions import NoCondition, condition
from scanloom.operators.scoring import SCORE_NAMES

ACTIONS = ("block", "warn", "info")
CONDITIONS = ("score-below", "finding-exists", "permission-used", "dependency-banned", "custom")
#: Columns that a custom condition may use.
CUSTOM_COLUMNS = (
    *SCORE_NAMES, "grade", "has_license", "has_types", "has_tests", "has_readme", "has_source", "code_complexity", "documentation_score", "test_coverage",
    "maintenance_health", "dependency_count", "outdated_dependencies", "lines_of_code",
)
VIOLATION = "skill_id string, policy string, rule_id string, severity string, message string, action string"


@dataclass(frozen=True)
class PolicyRule:
    id: str
    description: str
    severity: str
    action: str
    type: str
    value: dict = field(default_factory=dict, hash=False)


def _rule(id_: str, description: str, severity: str, action: str, type_: str, /, **value) -> PolicyRule:
    return PolicyRule(id_, description, severity, action, type_, value)


# The presets.
_STRICT = [
    ("critical-findings", "Block skills with critical security findings", "critical", "block", "finding-exists", {"severity": ["critical"]}),
    ("high-findings", "Block skills with high severity findings", "high", "block", "finding-exists", {"severity": ["high"]}),
    ("score-minimum", "Block skills with overall score below 80", "high", "block", "score-below", {"field": "overall", "threshold": 80}),
    ("medium-findings", "Warn on medium severity findings", "medium", "warn", "finding-exists", {"severity": ["medium"]}),
]
PRESETS: dict[str, list[PolicyRule]] = {
    "strict": [PolicyRule(f"strict-{i}", *rest) for i, *rest in _STRICT],
    "standard": [
        _rule("standard-critical-findings", "Block skills with critical security findings", "critical", "block", "finding-exists", severity=["critical"]),
        _rule("standard-high-findings", "Warn on high severity findings", "high", "warn", "finding-exists", severity=["high"]),
        _rule("standard-score-minimum", "Block skills with overall score below 60", "medium", "block", "score-below", field="overall", threshold=60),
        _rule("standard-medium-findings", "Informational notice on medium findings", "medium", "info", "finding-exists", severity=["medium"]),
    ],
    "permissive": [
        _rule("permissive-critical-cve", "Block skills with critical findings that have a CVE", "critical", "block", "finding-exists", severity=["critical"], withCve=True),
        _rule("permissive-critical-warn", "Warn on critical findings without CVE", "critical", "warn", "finding-exists", severity=["critical"]),
    ],
    "enterprise": [
        *[PolicyRule(f"enterprise-{i}", *rest) for i, *rest in _STRICT],
        _rule("enterprise-requires-license", "Block skills without a license", "high", "block", "custom", expression="NOT has_license", label="Skill must have a license"),
        _rule("enterprise-requires-types", "Block skills without TypeScript types", "high", "block", "custom", expression="NOT has_types", label="Skill must have TypeScript types"),
        _rule("enterprise-requires-tests", "Block skills without tests", "high", "block", "custom", expression="NOT has_tests", label="Skill must have tests"),
        _rule("enterprise-security-score", "Warn if security score is below 90", "medium", "warn", "score-below", field="security", threshold=90),
    ],
}


def _score_below(value: dict, scores: DataFrame) -> tuple[DataFrame, Column] | None:
    name, limit = value.get("field", "overall"), value.get("threshold")
    if name not in SCORE_NAMES or isinstance(limit, bool) or not isinstance(limit, (int, float)) or not 0 <= limit <= 100:
        return None
    return scores.filter(F.col(name) < limit), F.format_string(f"{name} score %s is below threshold {limit:g}", F.col(name).cast("string"))


def matching_findings(findings: DataFrame, value: dict) -> DataFrame:
    """Findings by severity, category and CVE; empty lists match all."""
    rows = findings
    for column, key in (("severity", "severity"), ("category", "category")):
        if value.get(key):
            rows = rows.filter(F.col(column).isin(*value[key]))
    return rows.filter(F.coalesce("cve", F.lit("")) != "") if value.get("withCve") else rows


def _finding_exists(value: dict, findings: DataFrame) -> tuple[DataFrame, Column]:
    """Skills with matching findings, naming the first three in severity order."""
    order = W.partitionBy("skill_id").orderBy("severity_rank", "file_ord", "rel_path", "rule", "pattern_ord", "at")
    text = F.concat(F.col("severity"), F.lit(":"), F.col("category"), F.lit("("), F.col("id"), F.lit(")"))
    rows = matching_findings(findings, value)
    # Spark keeps three rows of a skill before the shuffle, and counts are partial
    first = rows.select("skill_id", text.alias("text"), F.row_number().over(order).alias("rn")).filter("rn <= 3")
    texts = first.groupBy("skill_id").agg(*[F.max(F.when(F.col("rn") == k, F.col("text"))).alias(f"t{k}") for k in (1, 2, 3)])
    per = rows.groupBy("skill_id").agg(F.count("*").alias("n")).join(texts, "skill_id")
    more = F.when(F.col("n") > 3, F.format_string(" and %d more", F.col("n") - 3)).otherwise("")
    return per, F.concat(F.format_string("Found %d matching finding(s): ", F.col("n")), F.concat_ws(", ", "t1", "t2", "t3"), more)


def _banned(value: dict, skills: DataFrame, names: Column, what: str) -> tuple[DataFrame, Column]:
    banned = F.array(*[F.lit(b) for b in value.get("banned", [])]).cast("array<string>")
    used = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.array_contains(banned, n))
    rows = skills.select("skill_id", used.alias("used")).filter(F.size("used") > 0)
    return rows, F.concat(F.lit(f"Skill uses banned {what}: "), F.array_join("used", ", "))


def _custom(value: dict, results: DataFrame) -> tuple[DataFrame, Column] | None:
    """A condition on a skill's scores and metrics (see conditions); one that is none, or not true of a skill, is not met."""
    text = value.get("expression")
    if not isinstance(text, str) or not text:
        return None
    rows = results.select("skill_id", *[c for c in CUSTOM_COLUMNS if c in results.columns])
    try:
        rows = rows.filter(condition(text, rows.drop("skill_id")))
    except NoCondition:
        return None
    return rows, F.lit(f"Custom condition met: {value.get('label') or text}")


def evaluate(name: str, rules: list[PolicyRule], skills: DataFrame, findings: DataFrame, scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Violations of a policy: one row per skill and rule that is met (VIOLATION).

    Unknown condition types and invalid values are never met.
    """
    results = scores.join(metrics, "skill_id", "left")
    parts = []
    for rule in rules:
        met = {
            "score-below": lambda v: _score_below(v, scores),
            "finding-exists": lambda v: _finding_exists(v, findings),
            "permission-used": lambda v: _banned(v, skills, F.col("manifest.permissions"), "permission(s)"),
            "dependency-banned": lambda v: _banned(v, skills, F.map_keys("manifest.dependencies"), "dependency/ies"),
            "custom": lambda v: _custom(v, results),
        }.get(rule.type, lambda v: None)(rule.value)
        if met:
            rows, message = met
            parts.append(rows.select("skill_id", F.lit(name).alias("policy"), F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), message.alias("message"), F.lit(rule.action).alias("action")))
    return reduce(DataFrame.unionByName, parts) if parts else skills.sparkSession.createDataFrame([], VIOLATION)


def verdicts(skills: DataFrame, violations: DataFrame) -> DataFrame:
    """(skill_id, passed, blocked, n_violations, summary): one row per skill."""
    per = violations.groupBy("skill_id").agg(F.count("*").alias("n"), F.bool_or(F.col("action") == "block").alias("b"))
    rows = skills.select("skill_id").join(per, "skill_id", "left")
    n, blocked = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(False))
    text = F.when(n == 0, "All policy rules passed").when(blocked, F.format_string("%d violation(s), blocked", n)).otherwise(F.format_string("%d violation(s)", n))
    return rows.select("skill_id", (~blocked).alias("passed"), blocked.alias("blocked"), n.alias("n_violations"), text.alias("summary"))


def policy_errors(policy: object) -> list[str]:
    """Structural errors of a policy object; none if it is valid."""
    if not isinstance(policy, dict):
        return ["a policy is an object"]
    out = [] if isinstance(policy.get("name"), str) and policy["name"] else ["name is missing"]
    if not isinstance(policy.get("rules"), list):
        return [*out, "rules is no list"]
    for i, rule in enumerate(policy["rules"]):
        if not isinstance(rule, dict):
            out.append(f"rules[{i}] is no object")
            continue
        out += [f"rules[{i}].{k} is missing" for k in ("id", "severity", "action") if not isinstance(rule.get(k), str)]
        if rule.get("action") not in (*ACTIONS, None):
            out.append(f"rules[{i}].action is none of {', '.join(ACTIONS)}")
        condition = rule.get("condition")
        if not isinstance(condition, dict) or condition.get("type") not in CONDITIONS:
            out.append(f"rules[{i}].condition.type is none of {', '.join(CONDITIONS)}")
    return out
