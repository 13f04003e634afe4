"""Rules that look at all files of a skill, and hits that other facts decide.

Facts about files are combined per skill in one aggregation; everything else is
a join on the skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import dims
from scanloom.functions.dialect import jvm_exact
from scanloom.functions.web3_patterns import WEB3
from scanloom.operators.contents import marked, passed
from scanloom.operators.detectors import with_extension
from scanloom.operators.manifest_rules import FOUND, blank, found, none_or_empty


def skill_facts(files: DataFrame) -> DataFrame:
    """One row per skill that has files: what its files together have.

    files: as for ``read_contents``, or what that returns.
    """
    f = with_extension(passed(files).filter("rel_path IS NOT NULL"))
    path, ext = F.col("rel_path"), F.col("ext")
    code, web3 = ext.isin(*dims.CODE), ext.isin(*dims.EXTENSIONS["web3"])
    w3code, md = ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "sol"), ext.isin("md", "mdx")
    lock = F.lit(False)
    for name in dims.LOCKFILES:
        lock = lock | path.endswith(name)
    prose = md | (ext == "txt") | F.lower(F.substring_index(path, "/", -1)).isin("readme")
    readme = F.lower(path).endswith("skill.md") | F.lower(path).endswith("readme.md") | F.lower(path).endswith("readme")
    talks = readme & marked("AUTONOMY_TOKEN_RE")
    any_ = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return f.groupBy("skill_id").agg(
        F.sum(code.cast("long")).alias("code_files"),
        any_(code & marked("LOGGING"), "logs"),
        any_(code & marked("ERROR_LOGGING"), "logs_errors"),
        any_(code & marked("LOG_LIBRARY"), "log_library"),
        any_(path == ".gitignore", "gitignore"),
        F.max("ignores_missing").alias("gitignore_missing"),
        any_(lock, "lockfile"),
        any_(web3 & marked("PERMIT_MENTION_RE"), "permits"),
        any_(w3code & marked("PERSONAL_SIGN_RE"), "raw_signing"),
        any_(web3 & marked("PROTECTED_RPC_REFERENCE_RE"), "protected_rpc"),
        any_(prose & marked("DANGER_WARNING_RE"), "danger_warning"),
        F.min(F.when(web3 & marked("MCP_PROSE_RE") & marked("CHAIN_PROSE_RE"), F.struct("file_ord", "rel_path"))).alias("mcp_prose"),
        F.min(F.when(talks, F.struct("file_ord", "rel_path"))).alias("autonomy"),
    )


def skill_findings(skills: DataFrame, facts: DataFrame) -> DataFrame:
    """(skill_id, pattern_ord, FOUND) of the rules on a skill as a whole; a skill without files counts as having none."""
    s = skills.join(facts, "skill_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    w = F.col("manifest.web3")
    code = F.coalesce("code_files", F.lit(0))
    one = lambda test, *a, **k: F.when(test, found(*a, **k))
    path = lambda c, s: s.withField("rel_path", F.col(f"{c}.rel_path"))
    items = F.array(
        one((code > 0) & ~flag("logs"), "LOG-NONE", "logging", "medium", "No logging found in skill"),
        one((code > 2) & flag("logs") & ~flag("logs_errors"), "LOG-NOERR", "logging", "low", "No error-level logging found"),
        one((code > 2) & flag("logs") & ~flag("log_library"), "LOG-UNSTRUCTURED", "logging", "info", "No structured logging library detected"),
        one(~flag("gitignore"), "STOR-GIT-MISSING", "storage", "medium", "No .gitignore file found"),
        one(
            flag("gitignore") & (F.col("gitignore_missing") != ""),
            "STOR-GIT-INCOMPLETE", "storage", "low", "Incomplete .gitignore for secrets", None, ".gitignore", F.concat(F.lit("Missing patterns: "), "gitignore_missing"),
        ),
        one((F.size("manifest.dependencies") > 0) & ~flag("lockfile"), "SC-NOLOCK", "supply-chain", "high", "No lockfile found"),
        one(none_or_empty(w["policy"]["allowedContracts"]) & flag("permits"), "W02-010", "web3-permit-capture", "medium", "Permit/gasless flow without policy.allowedContracts"),
        F.when(
            F.col("mcp_prose").isNotNull() & (F.size(w["mcpServers"]) == 0),
            path("mcp_prose", found("W08-010", "web3-mcp-chain-drift", "low", "Skill mentions MCP in chain context but `web3.mcpServers` is empty")),
        ),
        F.when(
            w.isNotNull() & F.col("autonomy").isNotNull() & (F.coalesce(w["killSwitch"]["contract"], F.lit("")) == ""),
            path("autonomy", found("W12-020", "web3-no-audit-killswitch", "medium", "Skill describes itself as autonomous but has no kill switch")),
        ),
    )
    out = s.select("skill_id", F.posexplode(F.array_compact(items)).alias("pattern_ord", "f"))
    return out.select("skill_id", "pattern_ord", *[f"f.{part.split()[0]}" for part in FOUND.split(", ")])


#: Detectors whose hits are decided by their suffix too.
BY_SUFFIX = frozenset(("DEP-UNDECL", "W02-005", "W08-004"))
#: The facts of other files that ``decided_hits`` asks for, by rule, with the tests they are made of.
DECIDING = {"web3-blind-signing": ["PERSONAL_SIGN_RE"], "web3-rpc-substitution": ["PROTECTED_RPC_REFERENCE_RE"], "web3-no-user-confirmation": ["DANGER_WARNING_RE"]}


def deciding_facts(files: DataFrame, rule: str) -> DataFrame:
    """``skill_facts`` with those facts alone that decide the rule's hits; files are not read where there are none."""
    return skill_facts(passed(files, DECIDING[rule]) if rule in DECIDING else passed(files.limit(0), []))


def decided_hits(hits: DataFrame, skills: DataFrame, facts: DataFrame) -> DataFrame:
    """Keeps the file hits that the manifest and the skill's other files leave standing.

    One join per skill; what each detector needs is a condition on its rows.
    """
    w = F.col("manifest.web3")
    declared = F.array_distinct(
        F.concat(F.coalesce("manifest.tools", F.array().cast("array<string>")), F.flatten(F.coalesce(F.transform(w["mcpServers"], lambda s: F.coalesce(s["tools"], F.array().cast("array<string>"))), F.array().cast("array<array<string>>"))))
    )
    known = skills.select(
        "skill_id",
        F.coalesce(F.map_keys("manifest.dependencies"), F.array().cast("array<string>")).alias("deps"),
        w.isNotNull().alias("web3"),
        w["sessionKey"]["expiry"].isNotNull().alias("session_expiry"),
        F.transform(F.coalesce(w["policy"]["allowedContracts"], F.array().cast("array<string>")), F.lower).alias("allowed"),
        F.coalesce(w["signs7702"], F.lit(False)).alias("signs7702"),
        w["rpcRegistry"].isNotNull().alias("registry"),
        F.coalesce(w["rpcRegistry"].rlike(jvm_exact(*WEB3["PROTECTED_RPC_REFERENCE_RE"])), F.lit(False)).alias("registry_protected"),
        (~blank(w["bridgeProvider"])).alias("provider"),
        w["mcpServers"].isNotNull().alias("servers"),
        declared.alias("declared"),
    )
    some = facts.select("skill_id", "raw_signing", "protected_rpc", "danger_warning")
    d = F.col("detector")
    builtin = F.col("suffix").isin(*dims.NODE_BUILTINS, *[f"node:{b}" for b in dims.NODE_BUILTINS], *dims.BUN_BUILTINS)
    stands = (
        F.when(d == "DEP-UNDECL", (F.size("deps") > 0) & ~builtin & ~F.array_contains("deps", F.col("suffix")))
        .when(d == "W01-010", ~F.col("web3"))
        .when(d == "W01-020", ~F.col("session_expiry"))
        .when(d == "W02-005", ~F.array_contains("allowed", F.col("suffix")))
        .when(d == "W03-010", ~F.col("signs7702"))
        .when(d == "W04-006", F.col("raw_signing"))
        .when(d == "W05-003", ~F.col("protected_rpc") & ~F.col("registry_protected"))
        .when(d == "W05-011", ~F.col("registry"))
        .when(d == "W07-010", ~F.col("provider"))
        .when(d == "W08-003", ~F.col("servers"))
        .when(d == "W08-004", F.col("servers") & ~F.array_contains("declared", F.col("suffix")))
        .otherwise(True)
    )
    severity = F.when(d.isin("W12-040", "W12-041", "W12-042") & F.coalesce("danger_warning", F.lit(False)), "medium").otherwise(F.col("severity"))
    joined = hits.join(known, "skill_id").join(some, "skill_id", "left")
    return joined.filter(F.coalesce(stands, F.lit(False))).withColumn("severity", severity).select(*hits.columns)
