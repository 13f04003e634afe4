"""Queries that run operators of an audit over files and manifests made from the test tables, with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators import fuzzy, hosts, metrics, summary
from scanloom.operators.detectors import scan_files
from scanloom.operators.findings import detectors, stamped
from scanloom.operators.manifest_rules import manifest_findings
from scanloom.operators.scan_function import register_scan_function
from scanloom.operators.skill_rules import decided_hits, skill_facts, skill_findings
from scanloom.plans.queries import EXAMPLES_SQL, LINE_SQL, NUMBERED_SQL, document_files, findings_of, query, skills_of, table
from scanloom.packaging import shared_folder
from scanloom.sources.manifests import MANIFEST_SCHEMA
from scanloom.sources.package_source import packages, register_packages
from scanloom.streaming import skill_states

AS_OF = 1_700_000_000


def checks(*ids: str) -> list:
    return [d for d in detectors(True) if d.id in ids]


def changed(files: DataFrame, **words: str) -> DataFrame:
    """Files in which words stand for others, so that detectors find something there."""
    content = F.col("content")
    for old, new in words.items():
        content = F.replace(content, F.lit(f" {old} "), F.lit(new))
    return files.withColumn("content", content)


def changed_sql(**words: str) -> str:
    out = "text"
    for old, new in words.items():
        out = f"replace({out}, ' {old} ', '{new}')"
    return out


# ---- windows of lines and files


PROMISES = {"the": ".then(", "and": ".catch("}


@query(
    f"WITH {NUMBERED_SQL.replace('string_split(text', 'string_split(' + changed_sql(**PROMISES))}, loose AS (SELECT doc_id, line, count(*) FILTER (contains(line, '.catch(')) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS caught FROM numbered) "
    "SELECT doc_id || '.ts' AS rel_path, 'ERR-PROMISE' AS detector, count(*) || ' promise chains without .catch()' AS title FROM loose WHERE contains(line, '.then(') AND caught = 0 GROUP BY doc_id HAVING count(*) > 2"
)
def promises_without_catch(spark, sf_dir):
    """The check of the next four lines, over documents in which words are calls."""
    return scan_files(changed(document_files(spark, sf_dir, ".ts"), **PROMISES), checks("ERR-PROMISE")).select("rel_path", "detector", "title")


ADDRESS = "0x" + "12" * 20
FEES = {"the": f" {ADDRESS} ", "of": " fee "}


@query(
    f"WITH {NUMBERED_SQL.replace('string_split(text', 'string_split(' + changed_sql(**FEES))}, near AS (SELECT doc_id, k, line, bool_or(regexp_matches(line, '(?i)\\bfee\\b')) OVER w AS fee FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) "
    f"SELECT DISTINCT doc_id || '.ts' AS rel_path, CAST(k AS INTEGER) AS line FROM near WHERE fee AND contains(line, '{ADDRESS}') AND NOT regexp_matches(line, '^\\s*#') AND NOT contains(regexp_extract(line, '^(.*?){ADDRESS}', 1), '//')"
)
def fee_recipients_near_lines(spark, sf_dir):
    """Lines with an address that have a fee word within three lines."""
    files = changed(document_files(spark, sf_dir, ".ts"), **FEES)
    return scan_files(files, checks("W02-005")).select("rel_path", "line").distinct()


BOUNDS = {"the": " fetch( ", "that": " timeout: "}


@query(
    f"WITH f AS (SELECT doc_id, source, {changed_sql(**BOUNDS)} AS t FROM documents) SELECT source AS skill_id, count(*) AS n FROM f "
    "WHERE regexp_matches(t, '\\bfetch\\s*\\(') AND NOT regexp_matches(t, '(?i)AbortController|signal\\s*:|timeout\\s*:') GROUP BY source"
)
def calls_without_timeout(spark, sf_dir):
    """Files with one expression that lack another."""
    return scan_files(changed(document_files(spark, sf_dir, ".ts"), **BOUNDS), checks("DOS-TIMEOUT")).groupBy("skill_id").agg(F.count("*").alias("n"))


@query(
    "SELECT DISTINCT skill_id, rel_path, line_text AS evidence FROM (SELECT source AS skill_id, doc_id || '.ts' AS rel_path, trim(regexp_replace(regexp_replace(line, '\"[a-zA-Z0-9_\\-/+=]{16,}\"', '\"[REDACTED]\"', 'g'), '''[a-zA-Z0-9_\\-/+=]{16,}''', '''[REDACTED]''', 'g')) AS line_text, line "
    "FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE regexp_matches(line, '(?i)(?:token|auth[_-]?token|access[_-]?token|bearer)\\s*[:=]\\s*[\"''][a-zA-Z0-9_\\-./+=]{16,}[\"'']') "
    f"AND {EXAMPLES_SQL} AND NOT contains(line, '//') AND NOT regexp_matches(line, '^\\s*#')"
)
def secret_evidence_redacted(spark, sf_dir):
    """The evidence of findings of secrets never shows them."""
    return scan_files(document_files(spark, sf_dir, ".ts"), checks("STOR-004")).select("skill_id", "rel_path", "evidence").distinct()


# ---- findings


RULE_OF = {"F": "injection", "O": "dos", "P": "web3-oracle-manipulation"}


@query(
    "SELECT o_orderkey AS file_ord, detector || '-' || row_number() OVER (PARTITION BY o_custkey, CASE WHEN rule = 'web3-oracle-manipulation' THEN detector ELSE rule END ORDER BY o_orderkey) AS id, category, owasp_id, severity_rank FROM (SELECT *, "
    "CASE o_orderstatus WHEN 'F' THEN 'injection' WHEN 'O' THEN 'dos' ELSE 'web3-oracle-manipulation' END AS rule, CASE o_orderstatus WHEN 'F' THEN 'skill-injection' WHEN 'O' THEN 'denial-of-service' ELSE 'web3-oracle-manipulation' END AS category, "
    "CASE o_orderstatus WHEN 'F' THEN 'AST01' WHEN 'O' THEN 'AST06' ELSE 'AST-W10' END AS owasp_id, 'T-' || o_orderkey % 2 AS detector, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 3 END AS severity_rank FROM orders)"
)
def findings_stamped(spark, sf_dir):
    """Categories, risk ids, ranks and running numbers of findings."""
    o = table(spark, sf_dir, "orders")
    rule = F.when(F.col("o_orderstatus") == "F", RULE_OF["F"]).when(F.col("o_orderstatus") == "O", RULE_OF["O"]).otherwise(RULE_OF["P"])
    detector = F.concat(F.lit("T-"), (F.col("o_orderkey") % 2).cast("string"))
    text = lambda name, value=None: F.lit(value).cast("string").alias(name)
    raw = o.select(
        F.col("o_custkey").cast("string").alias("skill_id"), detector.alias("detector"), text("suffix"), F.when(F.col("o_orderkey") % 3 == 0, "critical").otherwise("low").alias("severity"), text("title", "t"), text("rel_path", "p"),
        F.lit(None).cast("int").alias("line"), text("evidence"), F.col("o_orderkey").alias("file_ord"), F.lit(0).alias("pattern_ord"), F.lit(0).cast("long").alias("at"), rule.alias("rule"),
    )
    return stamped(raw).select("file_ord", "id", "category", "owasp_id", "severity_rank")


IMPORTED = [f"pkg{i}" for i in range(6)] + ["fs", "node:path", "bun:test", "@s/a/b", "./local"]


@query(
    f"WITH i AS (SELECT p_partkey, {IMPORTED}[p_partkey % {len(IMPORTED)} + 1] AS spec FROM part), n AS (SELECT *, CASE WHEN spec = '@s/a/b' THEN '@s/a' ELSE spec END AS name FROM i) "
    "SELECT CAST(p_partkey % 50 AS VARCHAR) AS skill_id, name AS suffix, count(*) AS n FROM n WHERE spec NOT IN ('fs', 'node:path', 'bun:test', './local') AND p_partkey % 50 % 3 > 0 AND NOT (name = 'pkg1' OR (name = 'pkg2' AND p_partkey % 50 % 3 = 1)) GROUP BY 1, 2"
)
def undeclared_imports(spark, sf_dir):
    """Imports without those declared and those built in; skills that declare nothing have no such findings."""
    k = F.col("p_partkey")
    spec = F.element_at(F.array(*map(F.lit, IMPORTED)), (k % len(IMPORTED) + 1).cast("int"))
    files = table(spark, sf_dir, "part").select((k % 50).cast("string").alias("skill_id"), k.alias("file_ord"), F.concat(k.cast("string"), F.lit(".ts")).alias("rel_path"), F.concat(F.lit("import x from '"), spec, F.lit("'")).alias("content"))
    declared = F.when(k % 3 == 0, "{}").when(k % 3 == 1, '{"dependencies": {"pkg1": "1", "pkg2": "1"}}').otherwise('{"dependencies": {"pkg1": "1"}}')
    skills = spark.range(50).select(F.col("id").alias("p_partkey")).select(k.cast("string").alias("skill_id"), F.from_json(declared, MANIFEST_SCHEMA).alias("manifest"))
    return decided_hits(scan_files(files, checks("DEP-UNDECL")), skills, skill_facts(files)).groupBy("skill_id", "suffix").agg(F.count("*").alias("n"))


@query(
    "WITH f AS (SELECT p_partkey % 60 AS s, p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'console.log(1)' WHEN 1 THEN 'console.error(2)' WHEN 2 THEN 'pino()' ELSE 'x' END AS content, CASE WHEN p_partkey % 60 % 4 = 0 THEN 'md' ELSE 'ts' END AS ext FROM part), "
    "p AS (SELECT s, count(*) FILTER (ext = 'ts') AS code, bool_or(ext = 'ts' AND contains(content, 'console')) AS logs, bool_or(ext = 'ts' AND contains(content, 'console.error')) AS errors, bool_or(ext = 'ts' AND contains(content, 'pino')) AS library FROM f GROUP BY s) "
    "SELECT CAST(s AS VARCHAR) AS skill_id, unnest(list_filter([CASE WHEN code > 0 AND NOT logs THEN 'LOG-NONE' END, CASE WHEN code > 2 AND logs AND NOT errors THEN 'LOG-NOERR' END, CASE WHEN code > 2 AND logs AND NOT library THEN 'LOG-UNSTRUCTURED' END, 'STOR-GIT-MISSING', "
    "CASE WHEN s % 2 = 0 THEN 'SC-NOLOCK' END], lambda x: x IS NOT NULL)) AS detector FROM p"
)
def skill_level_findings(spark, sf_dir):
    """What all files of a skill together have or lack."""
    k = F.col("p_partkey")
    content = F.when(k % 5 == 0, "console.log(1)").when(k % 5 == 1, "console.error(2)").when(k % 5 == 2, "pino()").otherwise("x")
    ext = F.when(k % 60 % 4 == 0, ".md").otherwise(".ts")
    files = table(spark, sf_dir, "part").select((k % 60).cast("string").alias("skill_id"), k.alias("file_ord"), F.concat(k.cast("string"), ext).alias("rel_path"), content.alias("content"))
    held = F.when(k % 2 == 0, '{"dependencies": {"a": "1"}}').otherwise("{}")
    skills = files.select("skill_id").distinct().select("skill_id", F.col("skill_id").cast("long").alias("p_partkey")).select("skill_id", F.from_json(held, MANIFEST_SCHEMA).alias("manifest"))
    return skill_findings(skills, skill_facts(files)).select("skill_id", "detector")


# ---- manifests


def manifests_of(spark, sf_dir) -> DataFrame:
    """Skills with manifests of all sorts, by their number."""
    k = F.col("c_custkey")
    b = lambda i: F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1
    some = lambda test, value: F.when(test, value)
    texts = lambda *v: F.array(*map(F.lit, v))
    server = lambda **v: F.array(F.struct(*[F.lit(x).alias(n) for n, x in v.items()]))
    servers = (
        F.when(k % 6 == 1, F.to_json(server(url="https://evil.test/x"))).when(k % 6 == 2, F.to_json(server(url="weird", pinnedHash="h"))).when(k % 6 == 3, "[]").when(k % 6 == 4, F.to_json(server(pinnedVersion="1")))
    )
    policy = F.struct(some(b(4), F.lit("1")).alias("maxValuePerTx"), some(b(5), texts("0xa")).alias("allowedContracts"), some(b(6), F.lit("9")).alias("dailyCap"))
    key = F.struct(
        F.when(k % 5 == 1, 0).when(k % 5 == 2, AS_OF + 1000).when(k % 5 == 3, AS_OF + 864000).alias("expiry"), some(b(3), F.lit("1")).alias("valueLimit"), some(b(4), texts("t")).alias("targets"), some(b(5), texts("s")).alias("selectors"),
        some(b(6), F.array(F.lit(1))).alias("chainIds"), some(b(7), F.lit(ADDRESS)).alias("caveatEnforcer"),
    )
    web3 = F.struct(
        F.when(b(2), texts("hot")).otherwise(texts("cold")).alias("signers"), some(b(3), policy).alias("policy"), F.when(k % 3 == 1, F.array(F.lit(1))).when(k % 3 == 2, F.array(F.lit(1), F.lit(10))).alias("chains"), some(b(7), F.lit("r")).alias("rpcRegistry"),
        some(b(8), F.lit("p")).alias("bridgeProvider"), some(k % 5 < 4, key).alias("sessionKey"), some(b(9), F.lit(True)).alias("signs7702"), F.when(k % 7 == 0, F.struct(F.lit("spot").alias("type"), F.lit(None).cast("string").alias("source"))).when(k % 7 == 1, F.struct(F.lit(None).cast("string").alias("type"), F.lit("x").alias("source"))).alias("oracle"),
        some(b(8), F.struct(F.lit("s").alias("sink"))).alias("audit"), some(b(9), F.struct(F.lit("c").alias("contract"))).alias("killSwitch"), some(b(3), F.struct(F.lit("r").alias("runbook"))).alias("incident"),
    )
    whole = F.struct(
        F.when(k % 13 == 0, "q-fast").otherwise("plain").alias("name"), F.when(k % 17 < 5, "0.0.0").otherwise("1.0.0").alias("version"), some(k % 3 > 0, F.lit("MIT")).alias("license"), some(k % 11 < 5, texts("Swap")).alias("actions"),
        F.when(b(1), texts("shell:execute", "quiet")).otherwise(texts()).alias("permissions"), F.when(k % 9 == 0, F.array(F.struct(F.lit("K").alias("name"), F.lit(False).alias("redactInTrace")))).alias("secrets"), some(k % 4 > 0, web3).alias("web3"),
    )
    manifest = F.from_json(F.to_json(whole), MANIFEST_SCHEMA)
    listed = F.from_json(servers, "array<struct<url:string,pinnedHash:string,pinnedVersion:string,tools:array<string>>>")
    with_servers = F.when(F.col("m.web3").isNotNull() & listed.isNotNull(), F.col("m").withField("web3.mcpServers", listed)).otherwise(F.col("m"))
    # keys are small, and what is made of each is much work: a file of them that is one task's share to read is dealt over all
    keys = table(spark, sf_dir, "customer").select(k).repartition(4 * max(spark.sparkContext.defaultParallelism, 12))
    return keys.select(k, manifest.alias("m")).select(k.cast("string").alias("skill_id"), with_servers.alias("manifest"))


def _manifest_sql() -> str:
    b = lambda i: f"((k >> {i}) & 1 = 1)"
    no = lambda i: f"NOT (w AND {b(3)} AND {b(i)})"
    key = "(w AND k % 5 < 4)"
    conditions = {
        "W01-001 critical": f"w AND {b(2)} AND {no(4)}", "W01-002 high": f"w AND {b(2)} AND {no(5)}", "W01-003 high": f"w AND {b(2)} AND k % 3 = 0", "W01-004 medium": f"w AND {b(2)} AND {no(6)}", "W03-001 critical": f"w AND {b(9)} AND {no(5)}",
        "W05-010 low": f"w AND k % 3 > 0 AND NOT {b(7)}", "W07-001 high": f"w AND k % 3 = 2 AND NOT {b(8)}", "W08-001 high": "w AND k % 6 = 1", "W08-002 medium": "w AND k % 6 = 2", "W08-011 low": "w AND k % 6 = 1", "W09-001 high": f"{key} AND k % 5 = 0",
        "W09-002 high": f"{key} AND k % 5 IN (1, 3)", "W09-003 high": f"{key} AND NOT {b(3)}", "W09-004 high": f"{key} AND NOT {b(4)}", "W09-005 medium": f"{key} AND NOT {b(5)}", "W09-006 medium": f"{key} AND NOT {b(6)}", "W09-007 medium": f"{key} AND {b(7)}",
        "W10-010 high": "k % 11 < 5 AND NOT (w AND k % 7 = 1)", "W10-011 high": "w AND k % 7 = 0", "W11-030 medium": "k % 9 = 0", "W12-001 low": f"w AND NOT {b(8)}", "W12-002 low": f"w AND NOT {b(9)}", "W12-003 low": f"w AND NOT {b(3)}", "W12-030 low": "w AND k % 17 < 5",
        "W12-040 high": "k % 13 = 0", "W04M-001 medium": "k % 3 = 0", "W04M-002 low": f"NOT {b(1)}", "W04M-003 low": "true", "W04M-004 medium": no(5), "PERM-M critical": b(1),
    }
    items = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in conditions.items())
    return (
        f"SELECT skill_id, split_part(x, ' ', 1) AS detector, split_part(x, ' ', 2) AS severity FROM (SELECT CAST(k AS VARCHAR) AS skill_id, unnest(list_filter([{items}], lambda x: x IS NOT NULL)) AS x "
        "FROM (SELECT c_custkey AS k, c_custkey % 4 > 0 AS w FROM customer))"
    )


@query(_manifest_sql())
def manifest_rules(spark, sf_dir):
    """Permissions and the web3 block of manifests, under all their rules."""
    return manifest_findings(manifests_of(spark, sf_dir), F.lit(AS_OF)).select("skill_id", "detector", "severity")


# ---- summaries


@query("SELECT count(*) AS web3_skills, coalesce(sum(n), 0) AS web3_critical FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS n FROM customer WHERE c_custkey % 3 = 0)")
def web3_rollup(spark, sf_dir):
    detected = skills_of(spark, sf_dir).withColumn("is_web3", F.col("skill_id").cast("long") % 3 == 0)
    return summary.web3_rollup(detected, findings_of(spark, sf_dir))


@query(
    "WITH d AS (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2026-01-15 06:00:00') - epoch_us(CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts - to_days(CAST(event_id % 900 AS INTEGER)) END)) / 86400000000) AS BIGINT) AS days FROM events) "
    "SELECT event_id, CASE WHEN days IS NULL THEN 'unknown' WHEN days < 1 THEN 'today' WHEN days < 30 THEN days || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END || ' ago' WHEN days // 30 < 12 THEN (days // 30) || ' month' || CASE WHEN days // 30 = 1 THEN '' ELSE 's' END || ' ago' "
    "ELSE (days // 30 // 12) || ' year' || CASE WHEN days // 30 // 12 = 1 THEN '' ELSE 's' END || ' ago' END AS told FROM d"
)
def relative_times(spark, sf_dir):
    k = F.col("event_id")
    at = F.when(k % 7 != 0, F.col("ts") - F.make_dt_interval(days=(k % 900).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", summary.relative_time(at, F.lit("2026-01-15 06:00:00").cast("timestamp")).alias("told"))


# ---- metrics


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS skill_id, unnest(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'a:manifest' END, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'a:package' END END, CASE WHEN p_partkey % 3 = 0 THEN 'b' || (p_partkey % 7) || ':package' END, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'c:development' END, CASE WHEN p_partkey % 5 = 0 THEN 'flask:requirements' END], lambda x: x IS NOT NULL)) AS dependency FROM part"
)
def declared_dependencies(spark, sf_dir):
    """Each dependency once, from the first place that names it."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k, k.cast("string").alias("skill_id"))
    package = parts.filter(k % 3 == 0).select("skill_id", F.lit("package.json").alias("rel_path"), F.concat(F.lit('{"dependencies": {"a": "1", "b'), (k % 7).cast("string"), F.lit('": "2"}, "devDependencies": {"c": "3", "a": "1"}}')).alias("content"))
    required = parts.filter(k % 5 == 0).select("skill_id", F.lit("requirements.txt").alias("rel_path"), F.lit("# list\nflask>=2\n-r other.txt\n").alias("content"))
    files = package.union(required).withColumn("file_ord", F.lit(0).cast("long"))
    skills = parts.select("skill_id", F.from_json(F.when(k % 2 == 0, '{"dependencies": {"a": "1"}}').otherwise("{}"), MANIFEST_SCHEMA).alias("manifest"))
    return metrics.declared_dependencies(skills, files).select("skill_id", F.concat_ws(":", "name", "source").alias("dependency"))


JS = ["if (a) { b() } else if (c) { d() }", "for (;;) { x() }", "while (a && b || c) {}", "switch (a) { case 1: break }", "const f = a ? b : c", "try { a() } catch (e) {}", "// if (a)", "'if (a)'"]


@query(
    "WITH f AS (SELECT p_partkey % 40 AS s, p_partkey % 8 AS v FROM part) SELECT CAST(s AS VARCHAR) AS skill_id, count(*) FILTER (v = 0) AS \"if\", count(*) FILTER (v = 1) AS \"for\", count(*) FILTER (v = 2) AS \"while\", count(*) FILTER (v = 2) AS \"logical-and\", count(*) FILTER (v = 2) AS \"logical-or\", "
    "count(*) FILTER (v = 5) AS \"catch\" FROM f GROUP BY s"
)
def branches_of_scripts(spark, sf_dir):
    """Branches of script files without strings and comments."""
    k = F.col("p_partkey")
    content = F.element_at(F.array(*map(F.lit, JS)), (k % 8 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select((k % 40).cast("string").alias("skill_id"), F.concat(k.cast("string"), F.lit(".js")).alias("rel_path"), content.alias("content"), F.lit("javascript").alias("language"))
    return metrics.file_metrics(d, ("branches",)).groupBy("skill_id").agg(*[F.sum(F.element_at("branches", F.lit(n))).alias(n) for n in ("if", "for", "while", "logical-and", "logical-or", "catch")])


# ---- joins by keys instead of tests of pairs


HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)', 1), '[\[\]]', '', 'g'), '')"
LISTED = f"listed AS (SELECT {HOST} AS pattern FROM pages WHERE page_id % 11 = 0 UNION SELECT '*.' || regexp_extract({HOST}, '[^.]+[.][^.]+[.][^.]+$', 0) FROM pages WHERE page_id % 7 = 0 AND page_id % 3 = 0 UNION SELECT '*.example.net')"


@query(
    f"WITH {LISTED}, hosts AS (SELECT DISTINCT {HOST} AS host FROM pages), met AS (SELECT host, pattern, CASE WHEN pattern LIKE '*.%' THEN substr(pattern, 3) ELSE pattern END AS name FROM hosts JOIN listed ON "
    "host = pattern OR (pattern LIKE '*.%' AND (host = substr(pattern, 3) OR ends_with(host, substr(pattern, 2))))), best AS (SELECT host, first(pattern ORDER BY length(name) DESC, pattern LIKE '*.%') AS pattern FROM met GROUP BY host) "
    f"SELECT page_id, host, best.pattern FROM (SELECT page_id, {HOST} AS host FROM pages) LEFT JOIN best USING (host)"
)
def hosts_in_lists(spark, sf_dir):
    """Pages' hosts against a list of hosts and wildcards made of other pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, k = hosts.host_of(F.col("url")), F.col("page_id")
    listed = pages.filter(k % 11 == 0).select(host.alias("pattern"))
    listed = listed.union(pages.filter((k % 7 == 0) & (k % 3 == 0)).select(F.concat(F.lit("*."), F.regexp_extract(host, r"[^.]+[.][^.]+[.][^.]+$", 0))))
    listed = listed.union(spark.range(1).select(F.lit("*.example.net")))
    return hosts.covered_by(pages, listed).select("page_id", "host", "pattern")


@query(
    "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name, b.name AS other, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 2"
)
def part_names_within_two(spark, sf_dir):
    return fuzzy.names_within(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query(
    "WITH c AS (SELECT DISTINCT c_name AS name FROM customer), s AS (SELECT DISTINCT replace(s_name, 'Supplier', 'Customer') AS other FROM supplier) "
    "SELECT name, other, CAST(levenshtein(name, other) AS INTEGER) AS distance FROM c JOIN s ON levenshtein(name, other) <= 1"
)
def names_one_change_apart(spark, sf_dir):
    """Customers' names against suppliers' that are written alike."""
    suppliers = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return fuzzy.names_within(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), suppliers, distance=1)


# ---- the scanner in SQL


@query(
    f"WITH {LINE_SQL} SELECT source AS skill_id, 'STOR-004' AS detector, sum(len(regexp_extract_all(line, '(?i)(?:token|auth[_-]?token|access[_-]?token|bearer)\\s*[:=]\\s*[\"''][a-zA-Z0-9_\\-./+=]{{16,}}[\"'']'))) AS n FROM lines "
    f"WHERE {EXAMPLES_SQL} AND NOT contains(line, '//') AND NOT regexp_matches(line, '^\\s*#') GROUP BY source HAVING n > 0"
)
def scan_in_sql(spark, sf_dir):
    """The table function over documents, from SQL."""
    register_scan_function(spark)
    document_files(spark, sf_dir, ".ts").createOrReplaceTempView("scanned_documents")
    rows = spark.sql("SELECT * FROM scan_files(TABLE(SELECT skill_id, file_ord, rel_path, content FROM scanned_documents), 'storage')")
    return rows.filter("detector = 'STOR-004'").groupBy("skill_id", "detector").agg(F.count("*").alias("n"))


# ---- packages on disk


@query(
    "SELECT source AS skill, 'markdown' AS language, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents WHERE strlen(text) BETWEEN 1 AND 1048576 GROUP BY source"
)
def packages_written_and_read(spark, sf_dir):
    """Documents written as the files of packages, and read from there by the data source."""
    root = f"{shared_folder(spark)}/scanloom-packages-{uuid.uuid4().hex}"
    register_packages(spark)
    files = document_files(spark, sf_dir).select(F.col("skill_id").alias("skill"), "rel_path", "content")
    files.write.format("skill_packages").mode("append").save(root)
    read = packages(spark, root, partitions=8)
    return read.groupBy("skill", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.length("content")).alias("characters"))


# ---- streams with state


@query(
    f"WITH {LINE_SQL}, hits AS (SELECT source, sum(len(regexp_extract_all(line, '(?i)(?:token|auth[_-]?token|access[_-]?token|bearer)\\s*[:=]\\s*[\"''][a-zA-Z0-9_\\-./+=]{{16,}}[\"'']'))) AS n FROM lines "
    f"WHERE {EXAMPLES_SQL} AND NOT contains(line, '//') AND NOT regexp_matches(line, '^\\s*#') GROUP BY source), files AS (SELECT source, count(*) AS files FROM documents WHERE text IS NOT NULL GROUP BY source) "
    "SELECT source AS skill_id, files, CAST(coalesce(n, 0) AS BIGINT) AS critical, CAST(greatest(0, 100 - 30 * coalesce(n, 0)) AS INTEGER) AS security FROM files LEFT JOIN hits USING (source)"
)
def skills_followed(spark, sf_dir):
    """The totals that a stream of documents ends with."""
    root = f"{shared_folder(spark)}/scanloom-stream-{uuid.uuid4().hex}"
    documents = f"{sf_dir}/documents.parquet"
    # as a pattern, since a stream's path may otherwise be no single file
    rows = spark.readStream.schema(spark.read.parquet(documents).schema).parquet(f"{documents[:-1]}[t]")
    files = rows.select(F.col("source").alias("skill_id"), F.col("doc_id").alias("file_ord"), F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("rel_path"), F.col("text").alias("content"))

    def keep(totals: DataFrame, number: int) -> None:
        totals.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/totals/batch={number}")

    skill_states.follow(files, keep, f"{root}/state", checks("STOR-004")).awaitTermination()
    kept = spark.read.parquet(f"{root}/totals/*")
    last = kept.groupBy("skill_id").agg(F.max_by(F.struct("files", "critical", "security"), "batch").alias("t"))
    return last.select("skill_id", "t.*")
