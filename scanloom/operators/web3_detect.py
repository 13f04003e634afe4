"""Whether a skill is about web3: flags over its files, and a decision on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.dialect import jvm_exact
from scanloom.functions.dims import EXTENSIONS
from scanloom.functions.web3_patterns import WEB3
from scanloom.operators.contents import marked, passed
from scanloom.operators.detectors import with_extension

RPC = ["SEND_TX_RE", "SIGN_TX_RE", "PERSONAL_SIGN_RE", "SIGN_TYPED_DATA_RE", "SEND_RAW_TX_RE", "REQUEST_PERMISSIONS_RE", "RPC_TOOL_RE"]
SOURCE = "ts tsx js jsx mjs cjs py go rs sol".split()


def detect_web3(skills: DataFrame, files: DataFrame) -> DataFrame:
    """(skill_id, is_web3, confidence, signals): one row per skill.

    A web3 block is definite.  A library, an RPC method, a Solidity file or a
    named standard is likely, as are both weak signs together; one of them, or
    such language in the description and read-me files, is weak.  files: as for
    ``read_contents``, or what that returns.
    """
    f = with_extension(passed(files).filter("rel_path IS NOT NULL"))
    rpc = F.arrays_overlap("marks", F.array(*map(F.lit, RPC)))
    flags = {"lib": marked("WEB3_LIB_IMPORT_RE"), "rpc": rpc, "strong": marked("VERY_SPECIFIC_PROTOCOL_RE"), "prose": marked("WEAK_PROTOCOL_RE"), "address": marked("ADDRESS_RE")}
    # flags of Markdown files are told apart, as some skills' prose does not count
    read, markdown = F.col("ext").isin(*EXTENSIONS["web3"]), F.col("ext").isin("md", "mdx")
    any_ = lambda test, name: F.coalesce(F.bool_or(test), F.lit(False)).alias(name)
    per = f.groupBy("skill_id").agg(
        any_(F.col("ext").isin(*SOURCE), "has_source"),
        any_(F.col("ext") == "sol", "sol"),
        any_(F.col("rel_path").rlike(r"(?i)SKILL\.md\z|README") & marked("ONCHAIN_LANG_RE"), "readme"),
        *[any_(read & kind & c, f"{k}_{name}") for k, c in flags.items() for name, kind in (("prose", markdown), ("code", ~markdown))],
    )
    about = skills.select("skill_id", F.coalesce("manifest.description", F.lit("")).alias("description"), F.col("manifest.web3").isNotNull().alias("declared"))
    out = about.join(per, "skill_id", "left").fillna(False, [c for c in per.columns if c != "skill_id"])
    out = out.withColumn("meta", ~F.col("has_source") & F.col("description").rlike(jvm_exact(*WEB3["META_TOOL_DESCRIPTION_RE"])))
    out = out.select("skill_id", "description", "declared", "meta", "sol", "readme", *[(F.col(f"{k}_code") | F.col(f"{k}_prose") & ~F.col("meta")).alias(k) for k in flags])
    strong = F.col("lib") | F.col("rpc") | F.col("sol") | F.col("strong")
    weak = F.col("prose").cast("int") + F.col("address").cast("int")
    talk = F.col("readme") | F.col("description").rlike(jvm_exact(*WEB3["ONCHAIN_LANG_RE"]))
    confidence = F.when(F.col("declared"), "definite").when(strong | (weak == 2), "likely").when((weak == 1) | talk, "weak").otherwise("no")
    signals = F.array_compact(
        F.array(
            F.when(F.col("declared"), "manifest web3 block"),
            F.when(~F.col("declared") & F.col("meta") & ~strong, "security tooling"),
            *[F.when(~F.col("declared") & F.col(k), text) for k, text in (("lib", "client library"), ("rpc", "RPC method"), ("sol", "Solidity file"), ("strong", "protocol or standard"), ("prose", "generic prose"), ("address", "address"))],
            F.when(~F.col("declared") & ~strong & (weak == 0) & talk, "language in the description"),
        )
    )
    return out.select("skill_id", confidence.isin("definite", "likely").alias("is_web3"), confidence.alias("confidence"), signals.alias("signals"))


def promoted(detected: DataFrame) -> DataFrame:
    """Run-wide promotion: with one web3 skill, all count as definite, with that as a further signal."""
    any_web3 = detected.agg(F.coalesce(F.bool_or("is_web3"), F.lit(False)).alias("any"))
    rows = detected.crossJoin(F.broadcast(any_web3))  # a single row
    signals = F.when(F.col("any"), F.array_append("signals", F.lit("web3 profile active for the run"))).otherwise(F.col("signals"))
    return rows.select("skill_id", (F.col("is_web3") | F.col("any")).alias("is_web3"), F.when(F.col("any"), "definite").otherwise(F.col("confidence")).alias("confidence"), signals.alias("signals"))
