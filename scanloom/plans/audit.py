"""The audit: from skills and files to findings, metrics, scores, violations and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.contents import read_contents
from scanloom.operators.detectors import Detector, FileCheck
from scanloom.operators.findings import Plugin, file_detectors, findings
from scanloom.operators.metrics import recommendations, skill_metrics
from scanloom.operators.policy import PolicyRule, evaluate
from scanloom.operators.scoring import scores
from scanloom.operators.skill_rules import skill_facts
from scanloom.operators.summary import run_summary, web3_rollup
from scanloom.operators.web3_detect import detect_web3, promoted

PROFILES = ("default", "web3", "strict")


@dataclass(frozen=True)
class Audit:
    """Lazy results of one run; nothing is computed until one is used."""

    skills: DataFrame
    files: DataFrame
    web3: DataFrame
    findings: DataFrame
    metrics: DataFrame
    scores: DataFrame
    violations: DataFrame
    recommendations: DataFrame
    read: DataFrame
    facts: DataFrame

    def release(self) -> None:
        """Gives back what the run holds in memory; its results can still be computed."""
        for held in (self.metrics, self.findings, self.facts, self.read):
            held.unpersist()

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.scores, self.findings, self.violations)

    @property
    def web3_summary(self) -> DataFrame:
        return web3_rollup(self.web3, self.findings)


def audit(
    skills: DataFrame,
    files: DataFrame,
    profile: str = "default",
    policy: tuple[str, list[PolicyRule]] | None = None,
    as_of: Column | None = None,
    categories: list[str] | None = None,
    skip_rules: list[str] = (),
    plugins: list[tuple[str, Plugin]] = (),
    extra: list[Detector | FileCheck] = (),
) -> Audit:
    """Audits skills (skill_id, manifest) with their files (skill_id, file_ord, rel_path, content, language, size).

    profile: ``web3`` runs the web3 rules on all skills; ``default`` does so if
    any skill is found to be about web3; ``strict`` does not let one skill decide
    for others, and runs them on those that are.  extra: detectors beside the
    rules' own.  Contents are read once: a row a file (hits, tests, counts), the
    findings, and facts and metrics of each skill are held in memory or on the
    executors' disks until release(), and are computed again where an executor is
    lost.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile is none of {', '.join(PROFILES)}")
    read = read_contents(files, file_detectors(True, extra)).persist()
    detected = detect_web3(skills, read)
    if profile == "default":
        detected = promoted(detected)
    elif profile == "web3":
        detected = detected.select("skill_id", F.lit(True).alias("is_web3"), F.lit("definite").alias("confidence"), "signals")
    facts = skill_facts(read).persist()
    every = findings(skills, files, True, as_of, categories, skip_rules, extra, plugins, facts, read)
    if profile != "web3":
        # base rules for all, web3 rules where they apply
        plain = ~F.col("rule").startswith("web3-")
        applies = detected.select("skill_id", "is_web3")
        every = every.join(applies, "skill_id", "left").filter(plain | F.coalesce("is_web3", F.lit(False))).drop("is_web3")
    # scores, policies and reports all go on from these two
    every, metrics = every.persist(), skill_metrics(skills, files, read).persist()
    rated = scores(skills, every, metrics)
    name, rules = policy or ("none", [])
    violations = evaluate(name, rules, skills, every, rated, metrics)
    return Audit(skills, files, detected, every, metrics, rated, violations, recommendations(skills, every, metrics), read, facts)
