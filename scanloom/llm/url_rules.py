"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it
matches must contain.  The rarest of them, by counts over all URLs, is the
rule's key.  A URL's own tokens fetch the rules kept under them, and only these
candidates run their expression.  Everything is a DataFrame expression: the
rules lie in hash buckets of one constant array, so a token is looked up in one
step however many rules there are; each URL is one row throughout, and the only
shuffle is the count of the rules' own tokens.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``name`` is shown in results; of the rules that match, the highest ``rank`` wins, then the first name.

    ``pattern`` runs on host and path, lower-cased host first; ``tokens`` are runs
    of ``[a-z0-9]`` that stand whole in every URL that the pattern matches.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = False


def site_rule(action: str, host: str, path: str) -> UrlRule:
    """A host with all its subdomains and a path prefix; longer rules win."""
    whole = [*re.findall(TOKEN, host), *re.findall(TOKEN + "(?=[^a-z0-9])", path)]
    return UrlRule(host + path, action, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), 1000 + len(host + path), True)


def host_word_rule(action: str, words: str, rank: int = 1) -> UrlRule:
    """Words that stand in the host between dots and hyphens, such as ``casino``."""
    return UrlRule(f"host:{words}", action, f"^(?:[^/]*[.-])?{re.escape(words)}[.-]", tuple(re.findall(TOKEN, words)), rank)


def wildcard_rule(action: str, text: str, rank: int = 2) -> UrlRule:
    """Text anywhere in host and path, ``*`` for any characters; ``|`` at either end holds it there.

    Tokens are the runs that other characters of the text close off on both
    sides, so that they stand whole in the URL too.
    """
    plain = text.removeprefix("|").removesuffix("|")
    body = ".*".join(map(re.escape, plain.split("*")))
    edge = "|" if text.startswith("|") else "", "|" if text.endswith("|") else ""
    tokens = re.findall(rf"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])", f"{edge[0]}{plain}{edge[1]}")
    if not tokens:
        raise ValueError(f"no whole token in {text}")
    return UrlRule(f"url:{text}", action, ("^" if edge[0] else "") + body + (r"$" if edge[1] else ""), tuple(tokens), rank)


#: The listed rules of the query, then the general ones that judge what no listed rule fits.
SITE_RULES = (
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
)
WORD_RULES = tuple(
    host_word_rule("block", w)
    for w in ("adult", "ads-track", "bets", "betting", "casino", "cheap-pills", "escort", "lottery", "malware", "phishing", "porn", "poker", "spam", "tracker", "viagra", "warez", "xxx")
)
WILDCARD_RULES = tuple(
    wildcard_rule("block", t)
    for t in (
        "/ads/*/banner/", "/ads/*.gif|", ".ads.", "/affiliate/*/click/", "/banner/*/popup/", "/click/*/redirect/", "-download-*/crack/", "/free/*/download/", "/pixel/*.gif|", "/popup/", "/promo/*/click/", "/redirect/*-offer-",
        "/sponsored/", ".tracking.*/pixel/", "/win/*/prize/", "|cdn.*/ads/", "|www.*/affiliate/*-offer-",
    )
)
GENERAL_RULES = WORD_RULES + WILDCARD_RULES


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def token_counts(targets: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """Over all URLs, in how many each of the rules' tokens stands; as many rows as tokens at most."""
    own = json.dumps(sorted({t for r in rules for t in r.tokens}))
    wanted = targets.sparkSession.range(1).select(F.explode(F.from_json(F.lit(own), "array<string>")).alias("token"))
    found = targets.select(F.explode(F.array_distinct(_tokens(F.col("target")))).alias("token"))
    # the rules' own tokens, fewer than the constant that holds the rules
    return {r["token"]: r["count"] for r in found.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").count().collect()}


def bucketed(index: dict[str, list[UrlRule]]) -> tuple[Column, int]:
    """The rules under their keys, as an array of buckets by the key's checksum, and the number of buckets."""
    size = 1 << len(index).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for token, own in sorted(index.items()):
        held = [{"rank": r.rank, "name": r.name, "action": r.action, "listed": r.listed, "pattern": r.pattern} for r in own]
        buckets[crc32(token.encode()) % size].append({"token": token, "rules": held})
    kind = "array<array<struct<token:string,rules:array<struct<rank:int,name:string,action:string,listed:boolean,pattern:string>>>>>"
    return F.from_json(F.lit(json.dumps(buckets)), kind), size


def _tokens(target: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(target), F.lit(TOKEN), F.lit(0))


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges every URL.

    Returns a row per input row: page_id, host, path, rule (name of the winning
    listed rule, else null), word_rule (the winner among the others, else null),
    verdict, n_candidates int (expressions run).  A null URL or one without
    ``://`` has an empty host and path, fits no rule and gets ``default``.  Ties
    of rank go to the smaller name; very long URLs are judged whole; repeated
    rows and null ids are kept; other columns are not read; an empty table gives
    none.
    """
    host, path = host_and_path(F.col("url"))
    parts = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    targets = parts.withColumn("target", F.concat("host", "path"))
    counts = token_counts(targets, rules)
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)

    held, size = bucketed(index)

    def under(token: Column) -> Column:
        bucket = F.get(held, (F.crc32(token.cast("binary")) % size).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["token"] == token), lambda e: e["rules"]))

    fetched = F.flatten(F.transform(F.array_distinct(_tokens(F.col("target"))), under))
    best = lambda listed: F.array_sort(
        F.filter("fits", lambda r: r["listed"] == listed),
        lambda a, b: F.when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0),
    )
    judged = (
        targets.withColumn("candidates", fetched)
        .withColumn("fits", F.filter("candidates", lambda r: F.rlike(F.col("target"), r["pattern"])))
        .withColumn("site", F.get(best(True), 0))
        .withColumn("word", F.get(best(False), 0))
    )
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("site.name").alias("rule"),
        F.col("word.name").alias("word_rule"),
        F.coalesce(F.col("site.action"), F.col("word.action"), F.lit(default)).alias("verdict"),
        F.size("candidates").alias("n_candidates"),
    )
