"""Conditions and violations of policies."""

import pytest

from scanloom.operators.conditions import NoCondition, condition
from scanloom.operators.policy import PolicyRule, evaluate

ROWS = [("a", 50, "F", True, None), ("b", 90, "A", False, 70.0), ("c", 0, "D", None, 0.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "skill_id string, overall int, grade string, has_tests boolean, test_coverage double")


@pytest.mark.parametrize(
    ("text", "met"),
    [
        ("overall < 60", "ac"), ("NOT (overall < 60)", "b"), ("overall >= 50 AND grade <> 'F'", "b"), ("grade = 'F' OR grade = 'D'", "ac"), ("grade IN ('A', 'D')", "bc"),
        ("test_coverage IS NULL", "a"), ("test_coverage IS NOT NULL AND test_coverage < 50", "c"), ("100 / overall > 1", "ab"), ("overall % 0 = 1", ""), ("overall / 0 > 1 OR grade = 'A'", "b"),
        ("result.qualityMetrics.testCoverage !== null && result.qualityMetrics.testCoverage < 50", "c"), ("!has_tests", "b"), ("has_tests = TRUE", "a"), ("-overall + 10 * 2 < 0", "ab"),
        ("10 < overall < 60", "a"), ("overall * 99999999999999999999 > 1", "ab"), ("grade = 'it''s'", ""), ("has_tests", "a"),
    ],
)
def test_conditions(rows, text, met):
    assert "".join(sorted(r["skill_id"] for r in rows.filter(condition(text, rows)).collect())) == met


@pytest.mark.parametrize(
    "text",
    ["reflect('java.lang.System','setProperty','x','y') = 'x'", "overall", "overall <", "", "nothing > 1", "grade > 5", "overall = 'x'", "has_tests + 1 > 0", "(SELECT 1) = 1", "overall > 1; DROP TABLE x", "[x for x in (1,)]", "__import__('os')", "lambda: 1", "overall if has_tests else 1", "`overall` > 1", "a.b('x')", "(" * 500 + "1" + ")" * 500],
)
def test_what_is_no_condition(rows, text):
    with pytest.raises(NoCondition):
        condition(text, rows)


def test_a_policy_runs_no_code_and_is_not_met_where_it_is_no_condition(spark, rows):
    scores = rows.select("skill_id", "overall", "grade")
    metrics = rows.select("skill_id", "has_tests", "test_coverage")
    skills = rows.select("skill_id")
    jvm = "reflect('java.lang.System','setProperty','scanloom.test','1') is null"
    rules = [PolicyRule(f"r{k}", "", "low", "warn", "custom", {"expression": e}) for k, e in enumerate([jvm, "overall / 0 > 1", "overall > 80", None, 7])]
    found = evaluate("p", rules, skills, None, scores, metrics).collect()
    assert [(r["skill_id"], r["rule_id"], r["message"]) for r in found] == [("b", "r2", "Custom condition met: overall > 80")]
    assert spark._jvm.java.lang.System.getProperty("scanloom.test") is None


def test_first_three_findings_and_how_many_more(spark):
    found = [("a", "high", "c", f"X-{k}", 1, 0, f"p{k}", "r", 0, 0, None) for k in range(5)] + [("b", "high", "c", "Y-1", 1, 0, "p", "r", 0, 0, None), ("b", "low", "c", "Z-1", 3, 0, "p", "r", 0, 0, None)]
    findings = spark.createDataFrame(found, "skill_id string, severity string, category string, id string, severity_rank int, file_ord long, rel_path string, rule string, pattern_ord int, at long, cve string")
    rule = PolicyRule("f", "", "high", "block", "finding-exists", {"severity": ["high"]})
    empty = spark.createDataFrame([], "skill_id string, overall int")
    got = {r["skill_id"]: r["message"] for r in evaluate("p", [rule], empty, findings, empty, empty.select("skill_id")).collect()}
    assert got == {"a": "Found 5 matching finding(s): high:c(X-0), high:c(X-1), high:c(X-2) and 2 more", "b": "Found 1 matching finding(s): high:c(Y-1)"}
