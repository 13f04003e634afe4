"""Hosts against lists of hosts and wildcards, as one equi-join.

A wildcard ``*.example.com`` stands for ``example.com`` and all hosts below it.
A host with n labels has n suffixes, and a pattern covers it exactly when the
pattern's own name is one of them; so hosts meet patterns by equal keys, and a
list of any length costs one hash join instead of a test of each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host of an absolute URL, lower-cased, without user, port and the brackets of an address; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[\[\]]", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """array<struct<name, whole>>: the host and what follows each of its dots; addresses have no suffixes of their own."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    numbers = host.rlike(r"^[0-9.]+$") | host.contains(":")
    every = F.transform(F.sequence(F.lit(1), F.when(numbers, 1).otherwise(n)), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("name"), (i == 1).alias("whole")))
    return F.when(numbers, F.array(F.struct(host.alias("name"), F.lit(True).alias("whole")))).otherwise(every)


def covered_by(rows: DataFrame, patterns: DataFrame, url_col: str = "url", pattern_col: str = "pattern") -> DataFrame:
    """The rows with ``host`` and ``pattern``: the most specific pattern that covers the host, null if none does.

    The longest name wins, and of one name the pattern without a wildcard.
    Patterns are lower-cased; null and empty ones cover nothing, and repeated
    ones count once.  A row whose URL is null or has no host is covered by
    nothing.  Each distinct host is looked up once, however many rows have it;
    rows with a common host are dealt out by the engine's skew join.
    """
    pattern = F.lower(F.trim(F.col(pattern_col)))
    wild = pattern.startswith("*.")
    listed = patterns.select(F.when(wild, F.substring(pattern, 3, 1 << 20)).otherwise(pattern).alias("name"), wild.alias("wild")).filter("name <> ''")
    listed = listed.groupBy("name").agg(F.bool_or("wild").alias("any_wild"), F.bool_or(~F.col("wild")).alias("any_plain"))
    known = rows.withColumn("host", host_of(F.col(url_col)))
    hosts = known.select("host").filter("host IS NOT NULL").distinct()
    met = hosts.select("host", F.inline(suffixes(F.col("host")))).join(listed, "name").filter("any_wild OR whole")
    plain = F.col("whole") & F.col("any_plain")
    best = met.groupBy("host").agg(F.max(F.struct(F.length("name").alias("n"), plain.alias("plain"), "name")).alias("best"))
    named = best.select("host", F.when(F.col("best.plain"), F.col("best.name")).otherwise(F.concat(F.lit("*."), F.col("best.name"))).alias("pattern"))
    return known.join(named, "host", "left")
