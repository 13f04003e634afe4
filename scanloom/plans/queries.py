"""Queries that run the package's operators over the relational test tables, with SQL that says the same.

Customers stand for skills, orders for their findings (priority as severity,
status as rule), documents and pages for files, events for leaderboard entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions import dims
from scanloom.functions.web3_patterns import WEB3
from scanloom.operators import fuzzy, measures, metrics, policy, scoring, summary
from scanloom.operators.base_rules import file_detectors
from scanloom.operators.detectors import scan_files
from scanloom.operators.manifest_rules import dependency_findings
from scanloom.operators.web3_detect import RPC, detect_web3
from scanloom.plans.audit import audit
from scanloom.sources.files import admitted, language_of, platform_of
from scanloom.sources.manifests import MANIFEST_SCHEMA
from scanloom.streaming.audits import tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEVERITY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{s[0]}'" for p, s in zip(PRIORITIES, dims.SEVERITIES)) + " END"
FINDINGS_SQL = f"""findings AS (
  SELECT CAST(o_custkey AS VARCHAR) AS skill_id, 'F-' || o_orderkey AS id, {SEVERITY_SQL} AS severity, o_orderstatus AS category, 'rule-' || o_orderstatus AS rule,
    CASE o_orderstatus WHEN 'F' THEN 'AST01' WHEN 'O' THEN 'AST02' END AS owasp_id, o_orderkey AS file_ord,
    list_position(['critical', 'high', 'medium', 'low', 'info'], {SEVERITY_SQL}) - 1 AS severity_rank FROM orders)"""
WEIGHTED_SQL = FINDINGS_SQL + """, security AS (
  SELECT CAST(c_custkey AS VARCHAR) AS skill_id, CAST(greatest(0, least(100, 100 - 3 * coalesce(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 0 END), 0))) AS INTEGER) AS security
  FROM customer LEFT JOIN findings ON skill_id = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey
), scores AS (
  SELECT skill_id, security, CAST(skill_id AS BIGINT) % 101 AS quality, CAST(skill_id AS BIGINT) * 7 % 101 AS maintenance,
    CAST(floor(security * 0.5 + CAST(skill_id AS BIGINT) % 101 * 0.3 + CAST(skill_id AS BIGINT) * 7 % 101 * 0.2 + 0.5) AS INTEGER) AS overall FROM security
), graded AS (SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade FROM scores)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("skill_id"))


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for p, s in zip(PRIORITIES, dims.SEVERITIES) for x in (p, s[0])])
    o = table(spark, sf_dir, "orders").withColumn("severity", F.element_at(severity, F.col("o_orderpriority")))
    return o.select(
        F.col("o_custkey").cast("string").alias("skill_id"), F.concat(F.lit("F-"), F.col("o_orderkey").cast("string")).alias("id"), "severity", F.col("o_orderstatus").alias("category"),
        F.concat(F.lit("rule-"), "o_orderstatus").alias("rule"), F.when(F.col("o_orderstatus") == "F", "AST01").when(F.col("o_orderstatus") == "O", "AST02").alias("owasp_id"),
        F.lit(None).cast("string").alias("cve"), F.col("o_orderkey").alias("file_ord"), F.lit("f").alias("rel_path"), F.lit(0).alias("pattern_ord"), F.lit(0).alias("at"), summary.severity_rank(F.col("severity")).alias("severity_rank"),
    )


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = scoring.security_scores(skills_of(spark, sf_dir), findings_of(spark, sf_dir))
    key = F.col("skill_id").cast("long")
    rated = rated.withColumn("quality", key % 101).withColumn("maintenance", key * 7 % 101)
    rated = rated.withColumn("overall", scoring.overall_of(F.col("security"), F.col("quality"), F.col("maintenance")))
    return rated.withColumn("grade", scoring.grade_of(F.col("overall")))


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    score = (F.col("event_id") % 101).cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("repo"), F.col("event_id").cast("string").alias("skill_path"), F.col("props").alias("skill_name"), score.alias("overall_score"),
        F.when(F.col("event_id") % 50 == 0, "").otherwise(scoring.grade_of(score)).alias("grade"), *[(F.col("event_id") % n).cast("int").alias(f"{s}_findings") for s, n in (("critical", 3), ("high", 4), ("medium", 5), ("low", 6))],
        (F.col("event_type") == "click").alias("is_web3"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_scanned_at"), F.floor("value").cast("long").alias("install_count"),
        F.concat(F.lit("AST0"), (F.col("event_id") % 7).cast("string")).alias("top_finding_owasp"), F.col("event_type").alias("top_finding_rule"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("trending_rank"),
    )


ENTRIES_SQL = """entries AS (
  SELECT CAST(user_id AS VARCHAR) AS owner, event_type AS repo, CAST(event_id AS VARCHAR) AS skill_path, props AS skill_name, CAST(event_id % 101 AS INTEGER) AS overall_score,
    CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 101 >= 90 THEN 'A' WHEN event_id % 101 >= 75 THEN 'B' WHEN event_id % 101 >= 60 THEN 'C' WHEN event_id % 101 >= 40 THEN 'D' ELSE 'F' END AS grade,
    event_id % 3 AS critical_findings, event_id % 4 AS high_findings, event_id % 5 AS medium_findings, event_id % 6 AS low_findings, event_type = 'click' AS is_web3,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_scanned_at, CAST(floor(value) AS BIGINT) AS install_count, 'AST0' || (event_id % 7) AS top_finding_owasp FROM events)"""


def document_files(spark: SparkSession, sf_dir: str, suffix: str = ".md") -> DataFrame:
    """Documents as files of the skill that their source is."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("skill_id"), F.col("doc_id").alias("file_ord"), F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("rel_path"), F.col("text").alias("content"),
        F.lit("python" if suffix == ".py" else "markdown").alias("language"), F.octet_length("text").cast("long").alias("size"),
    )


def document_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.to_json(F.struct(F.col("source").alias("name"), F.lit("1.0.0").alias("version")))
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("skill_id"), F.from_json(name, MANIFEST_SCHEMA).alias("manifest"))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- sources


@query("SELECT source, count(*) AS n, sum(octet_length(encode(text))) AS bytes FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND 1048576 GROUP BY source")
def scan_filter_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return d.filter(admitted(F.col("content"), F.col("path"))).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))


@query("SELECT language, count(*) AS n FROM (SELECT CASE lower(regexp_extract(url, '[^.]*$')) " + " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in dims.LANGUAGES.items()) + " ELSE 'unknown' END AS language FROM pages) GROUP BY language")
def language_of_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(language_of(F.col("url")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def source_union_dedup(spark, sf_dir):
    c, s = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return c.unionByName(s).dropDuplicates(["k"])


@query(
    "SELECT coalesce(platform, 'none') AS platform, count(*) AS n FROM (SELECT CASE WHEN p LIKE '%claude%' THEN 'claude' WHEN p LIKE '%openclaw%' THEN 'openclaw' WHEN p LIKE '%hermes%' THEN 'hermes' WHEN p LIKE '%codex%' THEN 'codex' END AS platform "
    "FROM (SELECT lower('/home/' || ['.Claude', '.openclaw/x', '.hermes', '.codex', 'other'][c_custkey % 5 + 1]) AS p FROM customer)) GROUP BY 1"
)
def platform_infer(spark, sf_dir):
    names = F.array(*map(F.lit, [".Claude", ".openclaw/x", ".hermes", ".codex", "other"]))
    path = F.concat(F.lit("/home/"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select(F.coalesce(platform_of(path), F.lit("none")).alias("platform")).groupBy("platform").agg(F.count("*").alias("n"))


# ---- scores and summaries


@query(f"WITH {WEIGHTED_SQL} SELECT skill_id, security FROM security")
def severity_join_score(spark, sf_dir):
    return scoring.security_scores(skills_of(spark, sf_dir), findings_of(spark, sf_dir))


@query(f"WITH {WEIGHTED_SQL} SELECT skill_id, security, quality, maintenance, overall, grade FROM graded")
def score_grade(spark, sf_dir):
    return scores_of(spark, sf_dir)


@query(
    "SELECT c_custkey AS skill_id, CAST(greatest(0, least(100, floor(50 + greatest(0, 15 - c_custkey % 20) + (c_custkey % 11) / 10.0 * 10 + CASE WHEN c_custkey % 7 > 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END) "
    "+ least(10, (c_custkey % 120) / 10.0) + (CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 0 END) ELSE 20 END + CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END - least(10, 2 * (c_custkey % 9)) + 0.5))) AS INTEGER) AS quality FROM customer"
)
def quality_score(spark, sf_dir):
    k = F.col("c_custkey")
    columns = {
        "code_complexity": (k % 20).cast("double"), "documentation_score": (k % 11) / 10.0, "test_coverage": (k % 120).cast("double"), "outdated_dependencies": k % 9, "has_readme": k % 4 == 0,
        "has_license": k % 5 == 0, "has_tests": k % 2 == 0, "has_types": k % 3 == 0, "has_source": k % 7 > 0,
    }
    return table(spark, sf_dir, "customer").select(k.alias("skill_id"), scoring.quality_of(columns).alias("quality"))


@query(
    f"WITH {WEIGHTED_SQL} SELECT count(*) AS total_skills, CAST(floor(avg(overall) + 0.5) AS INTEGER) AS average_score, count(*) FILTER (grade IN ('A', 'B')) AS certified_skills, "
    + ", ".join(f"(SELECT count(*) FROM findings WHERE severity = '{s}') AS {s}_findings" for s in ("critical", "high", "medium", "low"))
    + ", (SELECT count(*) FROM findings) AS total_findings, (SELECT count(*) FROM scores WHERE overall < 60) AS blocked_skills FROM graded"
)
def run_summary(spark, sf_dir):
    skills, found, rated = skills_of(spark, sf_dir), findings_of(spark, sf_dir), scores_of(spark, sf_dir)
    rules = [r for r in policy.PRESETS["standard"] if r.type == "score-below"]
    return summary.run_summary(rated, found, policy.evaluate("standard", rules, skills, found, rated, skills))


CELLS_SQL = "cells AS (SELECT coalesce(owasp_id, rule) AS rule_key, skill_id, coalesce(['critical', 'high', 'medium', 'low', 'info'][min(severity_rank) FILTER (severity <> 'info') + 1], 'pass') AS worst, count(*) AS n FROM findings GROUP BY 1, 2)"


@query(f"WITH {FINDINGS_SQL}, {CELLS_SQL} SELECT * FROM cells")
def cell_matrix_worst(spark, sf_dir):
    return summary.matrix_cells(findings_of(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL}, {CELLS_SQL} SELECT k.rule_key, CAST(c_custkey AS VARCHAR) AS skill_id, coalesce(worst, 'pass') AS worst, coalesce(n, 0) AS n FROM customer CROSS JOIN (SELECT DISTINCT rule_key FROM cells) k LEFT JOIN cells ON cells.rule_key = k.rule_key AND cells.skill_id = CAST(c_custkey AS VARCHAR)")
def cell_matrix_dense(spark, sf_dir):
    return summary.dense_matrix(findings_of(spark, sf_dir), skills_of(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT skill_id, " + ", ".join(f"count(*) FILTER (coalesce(owasp_id, rule) = '{k}') AS \"{k}\"" for k in ("AST01", "AST02", "rule-P")) + " FROM findings GROUP BY skill_id")
def matrix_pivot(spark, sf_dir):
    return summary.rule_columns(findings_of(spark, sf_dir), ["AST01", "AST02", "rule-P"])


@query(f"WITH {WEIGHTED_SQL} SELECT (SELECT skill_id FROM scores ORDER BY overall DESC, skill_id LIMIT 1) AS best, (SELECT skill_id FROM scores ORDER BY overall, skill_id LIMIT 1) AS worst")
def best_worst_argmax(spark, sf_dir):
    return summary.best_and_worst(scores_of(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT skill_id, id, severity, rn FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY severity_rank, file_ord) AS rn FROM findings) WHERE rn <= 5")
def topk_findings_per_skill(spark, sf_dir):
    return summary.top_findings(findings_of(spark, sf_dir)).select("skill_id", "id", "severity", "rn")


@query(f"WITH {FINDINGS_SQL} SELECT skill_id, count(*) AS critical FROM findings WHERE severity = 'critical' GROUP BY skill_id ORDER BY critical DESC, skill_id LIMIT 3")
def worst3_skills(spark, sf_dir):
    return summary.worst_skills(findings_of(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT id, rule || '-' || row_number() OVER (PARTITION BY skill_id, rule ORDER BY file_ord) AS finding_id FROM findings")
def findings_seq_id(spark, sf_dir):
    order = W.partitionBy("skill_id", "rule").orderBy("file_ord", "pattern_ord", "at")
    return findings_of(spark, sf_dir).select("id", F.concat_ws("-", "rule", F.row_number().over(order).cast("string")).alias("finding_id"))


@query("SELECT r_name AS platform, '/' || n_name AS root, count(*) AS skills FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def platform_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    return summary.platform_rollup(placed.select(F.col("r_name").alias("platform"), F.concat(F.lit("/"), "n_name", F.lit("/"), "c_name").alias("skill_dir")))


@query(f"WITH {FINDINGS_SQL} SELECT rule_key, title, level FROM (SELECT coalesce(owasp_id, rule) AS rule_key, id AS title, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, row_number() OVER (PARTITION BY coalesce(owasp_id, rule) ORDER BY file_ord) AS rn FROM findings) WHERE rn = 1")
def sarif_rules_dedup(spark, sf_dir):
    dim = F.broadcast(dims.severity_dim(spark).select("severity", F.col("sarif_level").alias("level")))
    rows = findings_of(spark, sf_dir).join(dim, "severity")
    return rows.groupBy(F.coalesce("owasp_id", "rule").alias("rule_key")).agg(F.min(F.struct("file_ord", "id", "level")).alias("x")).select("rule_key", F.col("x.id").alias("title"), "x.level")


# ---- leaderboard


@query(
    f"WITH {ENTRIES_SQL} SELECT count(*) AS skills, sum(critical_findings) AS critical, sum(high_findings) AS high, sum(medium_findings) AS medium, sum(low_findings) AS low, CAST(floor(avg(overall_score) + 0.5) AS INTEGER) AS average_score, "
    "sum(install_count) AS installs, count(*) FILTER (is_web3) AS web3, max(CAST(last_scanned_at AS TIMESTAMP)) AS last_scan, count(*) FILTER (grade IN ('D', 'F')) AS failing, CAST(floor(avg(CASE WHEN grade IN ('D', 'F') THEN 1.0 ELSE 0 END) * 100 + 0.5) AS INTEGER) AS failing_percent FROM entries"
)
def leaderboard_agg(spark, sf_dir):
    return summary.leaderboard_totals(entries_of(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT owner, repo, skill_path, overall_score, grade FROM entries WHERE grade = 'A' AND critical_findings + high_findings > 0 AND lower(concat_ws(' ', owner, repo, skill_path, skill_name, repo, top_finding_owasp)) LIKE '%purchase%' ORDER BY overall_score DESC, owner, repo, skill_path LIMIT 24 OFFSET 24")
def leaderboard_filter_sort(spark, sf_dir):
    page = summary.leaderboard_page(entries_of(spark, sf_dir), grade="A", state="vulnerable", text=" Purchase ", sort="score", page=1)
    return page.select("owner", "repo", "skill_path", "overall_score", "grade")


@query(f"WITH {ENTRIES_SQL} SELECT CASE WHEN grade = '' THEN '?' ELSE grade END AS grade, count(*) AS n FROM entries GROUP BY 1")
def grade_histogram(spark, sf_dir):
    return summary.grade_histogram(entries_of(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT top_finding_owasp AS owasp_id, count(*) AS n FROM entries WHERE critical_findings + high_findings + medium_findings > 0 GROUP BY 1")
def owasp_histogram(spark, sf_dir):
    return summary.risk_histogram(entries_of(spark, sf_dir))


# ---- policies


@query(f"WITH {WEIGHTED_SQL} SELECT skill_id, 'p' AS policy, 'low' AS rule_id, 'high' AS severity, 'security score ' || security || ' is below threshold 70' AS message, 'block' AS action FROM scores WHERE security < 70")
def policy_score_below(spark, sf_dir):
    rated = scores_of(spark, sf_dir)
    rule = policy.PolicyRule("low", "", "high", "block", "score-below", {"field": "security", "threshold": 70})
    return policy.evaluate("p", [rule], rated.select("skill_id"), findings_of(spark, sf_dir), rated, rated.select("skill_id"))


@query(
    f"WITH {FINDINGS_SQL}, ranked AS (SELECT skill_id, severity || ':' || category || '(' || id || ')' AS t, row_number() OVER (PARTITION BY skill_id ORDER BY severity_rank, file_ord) AS rn FROM findings WHERE severity IN ('critical', 'high') AND category = 'F') "
    "SELECT skill_id, 'p' AS policy, 'bad' AS rule_id, 'high' AS severity, 'Found ' || count(*) || ' matching finding(s): ' || string_agg(t, ', ' ORDER BY rn) FILTER (rn <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS message, 'warn' AS action FROM ranked GROUP BY skill_id"
)
def policy_finding_exists(spark, sf_dir):
    rule = policy.PolicyRule("bad", "", "high", "warn", "finding-exists", {"severity": ["critical", "high"], "category": ["F"]})
    skills, rated = skills_of(spark, sf_dir), scores_of(spark, sf_dir)
    return policy.evaluate("p", [rule], skills, findings_of(spark, sf_dir), rated, skills)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS skill_id, 'Skill uses banned permission(s): ' || string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS message, 'block' AS action FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey")
def policy_banned_semi(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("skill_id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("permissions"))
    skills = used.select("skill_id", F.struct("permissions").alias("manifest"))
    rule = policy.PolicyRule("ban", "", "high", "block", "permission-used", {"banned": ["R", "A", "X"]})
    return policy.evaluate("p", [rule], skills, findings_of(spark, sf_dir), scores_of(spark, sf_dir), skills_of(spark, sf_dir)).select("skill_id", "message", "action")


@query(f"WITH {WEIGHTED_SQL} SELECT skill_id, 'Custom condition met: weak' AS message FROM graded WHERE overall < 50 AND security < 80")
def policy_custom(spark, sf_dir):
    rated = scores_of(spark, sf_dir)
    rule = policy.PolicyRule("weak", "", "high", "block", "custom", {"expression": "overall < 50 AND security < 80", "label": "weak"})
    return policy.evaluate("p", [rule], skills_of(spark, sf_dir), findings_of(spark, sf_dir), rated, rated.select("skill_id")).select("skill_id", "message")


@query(
    f"WITH {WEIGHTED_SQL}, v AS (SELECT skill_id, 'block' AS action FROM scores WHERE overall < 60 UNION ALL SELECT DISTINCT skill_id, 'block' FROM findings WHERE severity = 'critical' UNION ALL SELECT DISTINCT skill_id, 'warn' FROM findings WHERE severity = 'high' UNION ALL SELECT DISTINCT skill_id, 'info' FROM findings WHERE severity = 'medium') "
    "SELECT s.skill_id, count(*) FILTER (action = 'block') = 0 AS passed, count(*) FILTER (action = 'block') > 0 AS blocked, count(action) AS n_violations FROM scores s LEFT JOIN v ON v.skill_id = s.skill_id GROUP BY s.skill_id"
)
def policy_block_rollup(spark, sf_dir):
    skills, found, rated = skills_of(spark, sf_dir), findings_of(spark, sf_dir), scores_of(spark, sf_dir)
    return policy.verdicts(skills, policy.evaluate("standard", policy.PRESETS["standard"], skills, found, rated, skills)).drop("summary")


# ---- joins


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def allowlist_antijoin(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


DEP_NAMES = ["request", "lodahs", "qs", "event-stream", "some-very-long-name", "left-pad"]
DEP_VERSIONS = ["*", "latest", "^1.2.3", ">=0", "1.x", "github:a/b", "git+https://x/y#abcdef1", "file:../z", "next", ""]


@query(
    f"WITH d AS (SELECT {DEP_NAMES}[p_partkey % 6 + 1] AS n, {DEP_VERSIONS}[p_partkey // 6 % 10 + 1] AS v FROM part), u AS (SELECT * FROM d WHERE v LIKE '%://%' OR v LIKE 'github:%' OR v LIKE 'git%'), f AS ("
    "SELECT 'DEP-VULN' AS detector FROM d WHERE n IN ('qs', 'event-stream') UNION ALL SELECT 'DEP-TYPO' FROM d WHERE n = 'lodahs' UNION ALL SELECT 'DEP-SUSP' FROM d WHERE n = 'some-very-long-name' "
    "UNION ALL SELECT 'DEP-DEPR' FROM d WHERE n IN ('request', 'left-pad') UNION ALL SELECT 'DEP-WILD' FROM d WHERE v IN ('*', 'latest', '') UNION ALL SELECT 'DEP-GIT' FROM u "
    "UNION ALL SELECT 'SC-PIN' FROM d WHERE v IN ('*', 'latest', 'next') UNION ALL SELECT 'SC-WIDE' FROM d WHERE v = '>=0' UNION ALL SELECT 'SC-RANGE' FROM d WHERE v = '1.x' UNION ALL SELECT 'SC-GIT' FROM u "
    "UNION ALL SELECT 'SC-GIT-NOPIN' FROM u WHERE v NOT LIKE '%#abcdef1' UNION ALL SELECT 'SC-LOCAL' FROM d WHERE v LIKE 'file:%') SELECT detector, count(*) AS n FROM f GROUP BY detector"
)
def lookup_vuln_join(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    k = F.col("p_partkey")
    deps = table(spark, sf_dir, "part").select(k.cast("string").alias("skill_id"), pick(DEP_NAMES, k % 6).alias("name"), pick(DEP_VERSIONS, F.floor(k / 6) % 10).alias("version"))
    return dependency_findings(deps).groupBy("detector").agg(F.count("*").alias("n"))


# ---- detectors over texts

LINE_SQL = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)"
EXAMPLES_SQL = " AND ".join(f"NOT contains(lower(line), '{w}')" for w in dims.EXAMPLE_WORDS)


@query(
    f"WITH {LINE_SQL} SELECT source AS skill_id, sum(len(regexp_extract_all(line, '(?i)(?:token|auth[_-]?token|access[_-]?token|bearer)\\s*[:=]\\s*[\"''][a-zA-Z0-9_\\-./+=]{{16,}}[\"'']'))) AS n FROM lines "
    f"WHERE {EXAMPLES_SQL} AND NOT contains(line, '//') AND NOT regexp_matches(line, '^\\s*#') GROUP BY source HAVING n > 0"
)
def secret_token_detector(spark, sf_dir):
    chosen = [d for d in file_detectors() if d.id == "STOR-004"]
    return scan_files(document_files(spark, sf_dir, ".ts"), chosen).groupBy("skill_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\"[a-zA-Z0-9_\\-/+=]{16,}\"', '\"[REDACTED]\"', 'g'), '''[a-zA-Z0-9_\\-/+=]{16,}''', '''[REDACTED]''', 'g') AS text FROM documents")
def secret_token_redact_all(spark, sf_dir):
    """Redacted texts of every document, whatever stands before the quoted string."""
    return redacted_texts(table(spark, sf_dir, "documents"))


def redacted_texts(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.regexp_replace("text", "([\"'])[a-zA-Z0-9_\\-/+=]{16,}(\\1)", "$1[REDACTED]$2").alias("text"))


@query("SELECT coalesce(CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for p, n in measures.LICENSES) + " END, 'none') AS license, count(*) AS n FROM documents GROUP BY 1")
def license_classify(spark, sf_dir):
    files = document_files(spark, sf_dir).withColumn("rel_path", F.lit("LICENSE"))
    return metrics.file_metrics(files, ("texts",)).groupBy(F.coalesce("license_type", F.lit("none")).alias("license")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, role, count(*) AS n_lines, max(length(line)) AS longest FROM (SELECT conv_id, role, unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY 1, 2")
def line_explode_detector(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("conv_id", "role").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


NUMBERED_SQL = "numbered AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)"


@query(f"WITH {NUMBERED_SQL} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line, count(*) FILTER (contains(line, ' and ')) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS later FROM numbered) WHERE contains(line, ' the ') AND later = 0 GROUP BY doc_id")
def lookahead_4_lines(spark, sf_dir):
    # within the row, as an array: no line is shuffled
    lines = F.split("text", "\n")

    def alone(line, i):
        return line.contains(" the ") & ~F.exists(F.slice(lines, i + 2, 4), lambda x: x.contains(" and "))

    counted = table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, alone)).cast("long").alias("n"))
    return counted.filter("n > 0")


@query(f"WITH {NUMBERED_SQL} SELECT doc_id, k, near FROM (SELECT doc_id, k, line, count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM numbered) WHERE contains(line, 'License')")
def line_window_context(spark, sf_dir):
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("all"), F.posexplode(lines).alias("k", "line")).filter(F.col("line").contains("License"))
    k = F.col("k")
    return rows.select("doc_id", (k + 1).alias("k"), (F.least(k + 3, F.col("all") - 1) - F.greatest(k - 3, F.lit(0)) + 1).cast("long").alias("near"))


@query("SELECT source AS skill_id, count(*) FILTER (text IS NOT NULL AND regexp_matches(text, 'token') AND NOT regexp_matches(text, '(?i)license')) AS n FROM documents GROUP BY source")
def file_absent_guard(spark, sf_dir):
    test = F.col("text").rlike("token") & ~F.col("text").rlike("(?i)license")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("skill_id")).agg(summary.counted(F.coalesce(test, F.lit(False))).alias("n"))


@query("SELECT source AS skill_id, count(*) AS n FROM documents GROUP BY source HAVING bool_or(regexp_matches(text, 'Apache License')) AND NOT bool_or(regexp_matches(text, 'CC BY-NC'))")
def skill_flag_having(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("skill_id"))
    out = d.agg(F.count("*").alias("n"), F.bool_or(F.col("text").rlike("Apache License")).alias("a"), F.bool_or(F.col("text").rlike("CC BY-NC")).alias("b"))
    return out.filter("a AND NOT b").select("skill_id", "n")


# ---- metrics


@query(f"WITH {LINE_SQL} SELECT doc_id, count(*) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '#')) AS code, count(*) FILTER (starts_with(trim(line), '#')) AS comments FROM lines GROUP BY doc_id")
def loc_count(spark, sf_dir):
    d = metrics.file_metrics(document_files(spark, sf_dir, ".py").filter("content IS NOT NULL").withColumn("skill_id", F.col("file_ord")), ("lines",))
    return d.select(F.col("skill_id").alias("doc_id"), F.col("counted.code").cast("long").alias("code"), F.col("counted.comments").cast("long").alias("comments"))


@query(f"WITH {LINE_SQL} SELECT source AS skill_id, round(sum(CASE WHEN starts_with(trim(line), '#') THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM lines WHERE trim(line) <> '' GROUP BY source")
def comment_ratio(spark, sf_dir):
    d = metrics.file_metrics(document_files(spark, sf_dir, ".py").filter("content IS NOT NULL"), ("lines",))
    return d.groupBy("skill_id").agg(F.round(F.sum("counted.comments") / F.sum("counted.lines"), 6).alias("ratio"))


def _stripped_sql(text: str) -> str:
    for pattern, put in measures.PYTHON_STRIPS:
        quoted, put = pattern.replace("'", "''"), put.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{put}', 'g')"
    return text


# tenths, so that sums are exact
_TENTHS = {k: round(10 * measures.BRANCH_WEIGHTS[k]) for k in measures.PYTHON_BRANCHES}


@query(
    f"WITH clean AS (SELECT source, {_stripped_sql('text')} AS t FROM documents), counted AS (SELECT source AS skill_id, "
    + ", ".join(f"sum(len(regexp_extract_all(t, '{p}'))) AS \"{k}\"" for k, p in measures.PYTHON_BRANCHES.items())
    + " FROM clean GROUP BY source) SELECT *, (" + " + ".join(f'{_TENTHS[k]} * "{k}"' for k in _TENTHS) + ") / 10.0 AS weighted FROM counted"
)
def complexity_counts_all(spark, sf_dir):
    """All branch kinds of Python, and their sum by weight."""
    d = metrics.file_metrics(document_files(spark, sf_dir, ".py").filter("content IS NOT NULL"), ("branches",))
    out = d.groupBy("skill_id").agg(*[F.sum(F.element_at("branches", F.lit(k))).alias(k) for k in _TENTHS])
    return out.withColumn("weighted", sum((F.col(f"`{k}`") * n for k, n in _TENTHS.items()), F.lit(0)) / 10.0)


@query(
    "SELECT doc_id, CASE WHEN length(text) < 100 THEN 0.2 ELSE round(least(1, 0.2 + 0.5 * least(1, length(text) / 1000.0) + CASE WHEN h >= 3 THEN 0.1 WHEN h >= 1 THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '(?s)```.*?```') THEN 0.1 ELSE 0 END "
    "+ CASE WHEN regexp_matches(text, '(?i)(?:install|usage|getting\\s+started|quick\\s*start)') THEN 0.1 ELSE 0 END), 6) END AS score FROM (SELECT *, len(regexp_extract_all(text, '(?m)^#{1,3}\\s+')) AS h FROM documents WHERE text IS NOT NULL)"
)
def readme_score(spark, sf_dir):
    files = document_files(spark, sf_dir).filter("content IS NOT NULL").withColumn("rel_path", F.lit("README.md")).withColumn("skill_id", F.col("file_ord"))
    return metrics.file_metrics(files, ("texts",)).select(F.col("skill_id").alias("doc_id"), F.round("readme_score", 6).alias("score"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS skill_id, unnest(list_filter([CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') > 0 THEN 'Address critical security findings immediately' END, "
    "CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH') > 0 THEN 'Resolve high-severity security findings' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN 'Add automated tests' END, "
    "CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 > 0 THEN 'Add type definitions' END, CASE WHEN c_custkey % 7 = 0 THEN 'Add a README file' END, CASE WHEN c_custkey % 4 > 0 THEN 'Update outdated dependencies' END], lambda x: x IS NOT NULL)) AS title FROM customer"
)
def recommendations_explode(spark, sf_dir):
    k = F.col("skill_id").cast("long")
    skills = skills_of(spark, sf_dir)
    measured = skills.select("skill_id", (k % 2 == 0).alias("has_source"), (k % 3 == 0).alias("has_tests"), (k % 5 == 0).alias("has_types"), (k % 7 != 0).alias("has_readme"), (k % 4).alias("outdated_dependencies"))
    return metrics.recommendations(skills, findings_of(spark, sf_dir), measured).select("skill_id", "title")


@query(
    "WITH n AS (SELECT DISTINCT p_name AS name, length(p_name) AS l FROM part), s AS (SELECT name, CASE WHEN name = 'small' THEN 1000 WHEN starts_with(name, 'small') THEN 800 + floor(5.0 / l * 100 + 0.5) WHEN contains(name, 'small') THEN 600 + floor(5.0 / l * 100 + 0.5) - least(instr(name, 'small') - 1, 50) "
    "WHEN regexp_matches(name, '(?s)s.*m.*a.*l.*l') THEN 400 + floor(5.0 / l * 100 + 0.5) WHEN levenshtein('small', name) <= greatest(1, l // 3) THEN 200 - 10 * levenshtein('small', name) ELSE -1 END AS score FROM n) SELECT name, CAST(score AS INTEGER) AS score FROM s WHERE score >= 0 ORDER BY score DESC, name LIMIT 10"
)
def fuzzy_rank(spark, sf_dir):
    return fuzzy.rank_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), " Small ")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type")
def json_props_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


# ---- web3, audits, streams


def _any_sql(name: str) -> str:
    pattern, flags = WEB3[name]
    quoted = (f"(?{flags})" if flags else "") + pattern.replace("'", "''")
    return f"coalesce(bool_or(regexp_matches(text, '{quoted}')), false)"


@query(
    "WITH f AS (SELECT source, " + " OR ".join(_any_sql(n) for n in ["WEB3_LIB_IMPORT_RE", "VERY_SPECIFIC_PROTOCOL_RE", *RPC]) + f" AS strong, CAST({_any_sql('WEAK_PROTOCOL_RE')} AS INTEGER) + CAST({_any_sql('ADDRESS_RE')} AS INTEGER) AS weak FROM documents GROUP BY source) "
    "SELECT source AS skill_id, strong OR weak = 2 AS is_web3, CASE WHEN strong OR weak = 2 THEN 'likely' WHEN weak = 1 THEN 'weak' ELSE 'no' END AS confidence FROM f"
)
def web3_detect_flags(spark, sf_dir):
    return detect_web3(document_skills(spark, sf_dir), document_files(spark, sf_dir, ".ts")).select("skill_id", "is_web3", "confidence")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark, sf_dir):
    return tumbling_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query()
def audit_findings(spark, sf_dir):
    """The whole audit over documents as the files of 20 skills: findings."""
    run = audit(document_skills(spark, sf_dir), document_files(spark, sf_dir), "web3", as_of=F.lit(1_700_000_000))
    return run.findings.select("skill_id", "id", "rule", "severity", "title", "rel_path", "line", "evidence")


@query()
def audit_scores(spark, sf_dir):
    """The whole audit over documents as Python files: scores."""
    return audit(document_skills(spark, sf_dir), document_files(spark, sf_dir, ".py"), "default", as_of=F.lit(1_700_000_000)).scores
