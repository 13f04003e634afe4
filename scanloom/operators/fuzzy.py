"""Fuzzy search for a skill by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.scoring import half_up


def match_score(query: str, name: Column) -> Column:
    """1000 equal, 800 and more as a beginning, 600 within, 400 as a subsequence, 200 less the distance; else -1."""
    q = query.strip().lower()
    c = F.lower(F.trim(name))
    if not q:
        return F.lit(-1)
    n = F.length(c)
    share = half_up(F.lit(float(len(q))) / n * 100)
    at = F.instr(c, q) - 1
    subsequence = c.rlike("(?s)" + ".*".join(map(re.escape, q)))
    near, distance = F.greatest(F.lit(1), F.floor(n / 3)), F.levenshtein(F.lit(q), c)
    out = F.when(n == 0, -1).when(c == q, 1000).when(c.startswith(q), 800 + share).when(at >= 0, 600 + share - F.least(at, F.lit(50)))
    return out.when(subsequence, 400 + share).when(distance <= near, 200 - distance * 10).otherwise(-1).cast("int")


def rank_names(names: DataFrame, query: str, column: str = "name", k: int = 10) -> DataFrame:
    """The k best names that match at all, best first, then by name."""
    rows = names.withColumn("score", match_score(query, F.col(column)))
    return rows.filter("score >= 0").orderBy(F.desc("score"), column).limit(k)


def sure_match(names: DataFrame, query: str, column: str = "name") -> str | None:
    """The one name meant: an exact match, or 100 ahead of the next; else null."""
    top = rank_names(names, query, column, 2).collect()
    if not top:
        return None
    ahead = len(top) == 1 or top[0]["score"] >= 1000 or top[0]["score"] - top[1]["score"] >= 100
    return top[0][column] if ahead else None


# ---- names close to each other


def deletions(name: Column, distance: int) -> Column:
    """The name and all that is left of it when up to ``distance`` characters go."""

    def shorter(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    out = layer = F.array(name)
    for _ in range(distance):
        layer = F.array_distinct(F.flatten(F.transform(layer, shorter)))
        out = F.array_union(out, layer)
    return out


def names_within(left: DataFrame, right: DataFrame | None = None, column: str = "name", distance: int = 2) -> DataFrame:
    """(name, other, distance): names of ``left`` and of ``right`` that at most ``distance`` single changes take into each other.

    Two such names have a form in common when up to ``distance`` characters are
    deleted from each, so names meet by equal forms (as 64-bit hashes) and the
    edit distance verifies: no pair of names is tried that has nothing in common.
    Without ``right``, the names of ``left`` among each other, each pair once
    (name < other).  Repeated names count once; null names are left out.  Case
    counts.  A name of n characters has some n^distance / 2 forms.
    """

    def keyed(df: DataFrame, to: str) -> DataFrame:
        names = df.select(F.col(column).alias(to)).filter(F.col(to).isNotNull()).distinct()
        return names.select(to, F.explode(F.transform(deletions(F.col(to), distance), lambda s: F.xxhash64(s))).alias("form"))

    one, two = keyed(left, "name"), keyed(left if right is None else right, "other")
    # names that share one form mostly share many: pairs come together before they are verified
    pairs = one.join(two, "form").filter("name < other" if right is None else "true").select("name", "other").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "other")).filter(F.col("distance") <= distance)
