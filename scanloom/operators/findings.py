"""Findings of all rules, stamped, numbered and in order."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.dims import RULES, WEB3_RULES, rule_dim, severity_dim
from scanloom.operators import base_rules, web3_rules
from scanloom.operators.contents import hits_of, read_contents
from scanloom.operators.detectors import FAILED, FAILED_CATEGORY, FAILED_RULE, Detector, FileCheck
from scanloom.operators.manifest_rules import dependencies, dependency_findings, manifest_findings
from scanloom.operators.skill_rules import decided_hits, skill_facts, skill_findings

#: Columns of a finding.
FINDING = [
    "skill_id", "id", "rule", "severity", "category", "title", "rel_path", "line", "evidence", "cve", "owasp_id", "severity_rank", "weight", "file_ord", "pattern_ord", "at", "detector", "suffix",
]
Plugin = Callable[[DataFrame, DataFrame], DataFrame]


def detectors(web3: bool) -> list[Detector | FileCheck]:
    return [*base_rules.file_detectors(), *(web3_rules.file_detectors() if web3 else [])]


def file_detectors(web3: bool, extra: list[Detector | FileCheck] = ()) -> list[Detector | FileCheck]:
    """What runs on files: the rules' detectors and a caller's own."""
    return [*detectors(web3), *extra]


def introspect(web3: bool = True) -> list[dict]:
    """What an audit runs: rules in running order with category, risk id and the ids of their file detectors."""
    held = detectors(web3)
    return [{"rule": r, "category": c, "owasp_id": o, "detectors": [d.id for d in held if d.rule == r]} for r, c, o in RULES if web3 or r not in WEB3_RULES]


def rule_names(web3: bool = True) -> list[str]:
    return [r for r, _, _ in RULES if web3 or r not in WEB3_RULES]


def raw_findings(skills: DataFrame, files: DataFrame, web3: bool = True, as_of: Column | None = None, extra: list[Detector | FileCheck] = (), facts: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """Findings of all rules, before they are stamped.

    skills (skill_id, manifest), files (skill_id, file_ord, rel_path, content).
    as_of: epoch seconds that session keys are judged by.  facts: skill_facts of
    the files, where the caller holds them; they are used three times.  read: the
    files after ``read_contents`` with ``file_detectors(web3, extra)``.
    """
    as_of = F.unix_timestamp() if as_of is None else as_of
    chosen = file_detectors(web3, extra)
    read = read_contents(files, chosen) if read is None else read
    rule_of = {d.id: d.rule for d in chosen} | {h: r for h, r in (("PERM-ESC", "permissions"), ("PERM-SYS", "permissions"), ("SC-SSL", "supply-chain"), ("SC-AUTH", "supply-chain"))}
    if web3:
        rule_of |= {"W05-002": "web3-rpc-substitution", "W05-011": "web3-rpc-substitution", "W09-011": "web3-session-key-erosion", "W11-002": "web3-key-material-leak", "W11-003": "web3-key-material-leak"}
    table = F.create_map(*[F.lit(x) for pair in rule_of.items() for x in pair])
    facts = skill_facts(read) if facts is None else facts
    rule = F.when(F.col("detector").startswith(FAILED), FAILED_RULE).otherwise(F.try_element_at(table, F.col("detector")))
    hits = decided_hits(hits_of(read), skills, facts).withColumn("rule", rule)
    whole = skill_findings(skills, facts)
    manifest = manifest_findings(skills, as_of)
    if not web3:
        whole, manifest = (x.filter(~F.col("rule").isin(*WEB3_RULES)) for x in (whole, manifest))
    danger = facts.select("skill_id", "danger_warning")
    manifest = manifest.join(danger, "skill_id", "left").withColumn("severity", F.when((F.col("detector") == "W12-040") & F.col("danger_warning"), "medium").otherwise(F.col("severity"))).drop("danger_warning")
    declared = dependency_findings(dependencies(skills))
    before = lambda df: df.select("*", F.lit(-1).cast("long").alias("file_ord"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("int").alias("line"))
    after = whole.select("*", F.lit(1 << 40).alias("file_ord"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("int").alias("line"))
    parts = [hits, before(manifest), before(declared), after]
    return reduce(lambda a, b: a.unionByName(b.select(*a.columns)), parts)


def stamped(raw: DataFrame, categories: list[str] | None = None, skip_rules: list[str] = ()) -> DataFrame:
    """Adds category, risk id and rank, gives each finding its id, and filters by category and rule.

    Ids of numbered detectors carry the running number in the skill and rule;
    those of others their suffix.  Ids need not be unique; skill, detector, path
    and offset are.  A rule that failed in a skill is told once.
    """
    spark = raw.sparkSession
    failed = spark.createDataFrame([(FAILED_RULE, FAILED_CATEGORY, None)], "rule string, category string, owasp_id string")
    dim = F.broadcast(rule_dim(spark).select("rule", "category", "owasp_id").union(failed))
    if categories:
        dim = dim.filter(F.col("category").isin(*categories))
    rows = raw.join(dim, "rule")
    if skip_rules:
        rows = rows.filter(~F.col("rule").isin(*skip_rules))
    rows = rows.join(F.broadcast(severity_dim(spark).select("severity", F.col("rank").alias("severity_rank"), "weight")), "severity")
    order = W.partitionBy("skill_id", F.when(F.col("rule").isin("web3-oracle-manipulation", FAILED_RULE), F.col("detector")).otherwise(F.col("rule"))).orderBy("file_ord", "rel_path", "pattern_ord", "at", "suffix")
    plain = [d.id for d in detectors(True) if isinstance(d, FileCheck) and not d.numbered] + ["PERM-ESC", "PERM-SYS", "SC-SSL", "SC-AUTH"]
    named = F.col("rule").isin("dependencies", "supply-chain", FAILED_RULE) | F.col("detector").isin(*plain) | F.col("detector").startswith("PERM-") & (F.col("file_ord") < 0) | (F.col("file_ord") == 1 << 40)
    rows = rows.withColumn("number", F.row_number().over(order)).filter((F.col("rule") != FAILED_RULE) | (F.col("number") == 1))
    number = F.col("number").cast("string")
    id_ = F.when(named, F.concat_ws("-", "detector", "suffix")).when(F.col("rule") == "logging", F.concat_ws("-", "detector", "suffix", number)).otherwise(F.concat_ws("-", "detector", F.when(F.col("suffix") == "meta", F.col("suffix")), number))
    return rows.withColumn("id", id_).withColumn("cve", F.lit(None).cast("string")).select(*FINDING)


def findings(
    skills: DataFrame,
    files: DataFrame,
    web3: bool = True,
    as_of: Column | None = None,
    categories: list[str] | None = None,
    skip_rules: list[str] = (),
    extra: list[Detector | FileCheck] = (),
    plugins: list[tuple[str, Plugin]] = (),
    facts: DataFrame | None = None,
    read: DataFrame | None = None,
) -> DataFrame:
    """All findings; plugins add rows of FINDING as they are (not stamped, not skipped).

    A plugin that raises, or whose rows don't fit, is passed over with a warning;
    what its own functions raise later, in tasks, is not caught.
    """
    out = stamped(raw_findings(skills, files, web3, as_of, extra, facts, read), categories, skip_rules)
    for name, plugin in plugins:
        try:
            joined = out.unionByName(plugin(skills, files), allowMissingColumns=True)
            joined.schema  # noqa: B018  resolves the plugin's plan
        except Exception as error:  # noqa: BLE001  whatever a plugin raises is its own
            logging.getLogger(__name__).warning("plugin %s failed: %s", name, error)
            continue
        out = joined
    return out


def in_severity_order(found: DataFrame) -> DataFrame:
    return found.orderBy("skill_id", "severity_rank", "file_ord", "rel_path", "rule", "pattern_ord", "at")
