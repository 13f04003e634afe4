"""Rules on manifests, as expressions on the manifest struct.

Each rule is a condition and a finding; a skill's findings are the non-null
ones of one array, so the manifest is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import dims, web3_dims
from scanloom.functions.base_patterns import EXTERNAL_INSTRUCTIONS
from scanloom.functions.dialect import jvm_exact

FOUND = "detector string, rule string, severity string, title string, suffix string, rel_path string, evidence string"


def found(detector: str, rule: str, severity: Column | str, title: Column | str, suffix: Column | None = None, path: str | None = None, evidence: Column | None = None) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(detector).alias("detector"), F.lit(rule).alias("rule"), text(severity).alias("severity"), text(title).alias("title"),
        (none if suffix is None else suffix).alias("suffix"), F.lit(path).cast("string").alias("rel_path"), (none if evidence is None else evidence).alias("evidence"),
    )


def none_or_empty(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def is_in(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.isin(*words), F.lit(False))


def _many(items: Column, test, make) -> Column:
    """Findings for the items of an array that pass a test."""
    return F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), test), make)


def permission_findings(m: Column) -> list[Column]:
    permissions, tools = m["permissions"], m["allowedTools"]
    severity = F.create_map(*[F.lit(x) for pair in dims.DANGEROUS_PERMISSIONS.items() for x in pair])
    name = lambda t: F.trim(F.regexp_extract(t, r"^([^(]*)", 1))
    scope = lambda t: F.trim(F.regexp_extract(t, r"^[^(]+\((.*)\)\z", 1))
    shell = lambda t: F.lower(name(t)).isin(*dims.SHELL_TOOLS) & scope(t).isin("", "*", ":*", "*:*")
    quoted = F.concat(F.lit("permissions: ["), F.concat_ws(", ", F.transform(permissions, lambda p: F.concat(F.lit('"'), p, F.lit('"')))), F.lit("]"))
    return [
        _many(
            permissions,
            lambda p: p.isin(*dims.DANGEROUS_PERMISSIONS),
            lambda p: found("PERM-M", "permissions", F.element_at(severity, p), F.concat(F.lit("Dangerous permission requested: "), p), p, "skill.json", F.concat(F.lit('permissions: ["'), p, F.lit('"]'))),
        ),
        F.array(F.when(F.size(permissions) > 5, found("PERM-M-COUNT", "permissions", "medium", F.concat(F.lit("Excessive number of permissions ("), F.size(permissions).cast("string"), F.lit(")")), None, "skill.json", quoted))),
        _many(tools, lambda t: name(t) == "*", lambda t: found("PERM-TOOL-WILDCARD", "permissions", "critical", "Wildcard tool grant pre-approves every tool", t, "SKILL.md", F.concat(F.lit("allowed-tools: "), t))),
        _many(tools, shell, lambda t: found("PERM-TOOL-SHELL", "permissions", "high", F.concat(F.lit("Unrestricted shell grant in allowed-tools: "), name(t)), t, "SKILL.md", F.concat(F.lit("allowed-tools: "), t))),
    ]


def instruction_findings(m: Column) -> list[Column]:
    """The instruction patterns on the manifest's own texts; the first four only."""
    text = F.concat_ws("\n", m["description"], m["metadataText"])
    rows = [r for r in EXTERNAL_INSTRUCTIONS if r[0] <= "XINST-004"]
    line = lambda p: F.trim(F.regexp_extract(text, f"(?:^|\\n)([^\\n]*{p}[^\\n]*)", 1))
    return [
        F.array(F.when(text.rlike(jvm_exact(p, f)), found(i, "external-instructions", s, f"{t} (manifest metadata)", F.lit("meta"), "SKILL.md", line("(?i)" + jvm_exact(p))))) for i, s, t, p, f in rows
    ]


def web3_findings(m: Column, as_of: Column) -> list[Column]:
    """Rules on the web3 block; ``as_of`` is the time in epoch seconds."""
    w = m["web3"]
    p, key = w["policy"], w["sessionKey"]
    hot = F.coalesce(F.array_contains(w["signers"], "hot"), F.lit(False))
    one = lambda test, *a, **k: F.array(F.when(test, found(*a, **k)))
    signing, session, audit, meta = "web3-signing-authority", "web3-session-key-erosion", "web3-no-audit-killswitch", "web3-metadata-completeness"
    url_of = lambda s: F.coalesce(s["url"], F.lit("<unspecified>"))
    servers = F.coalesce(w["mcpServers"], F.array().cast("array<struct<url:string,pinnedHash:string,pinnedVersion:string,tools:array<string>>>"))
    host = lambda s: F.regexp_extract(F.lower(s["url"]), r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    plain, wild = [h for h in web3_dims.MCP_HOSTS if h[0] != "*"], [h[2:] for h in web3_dims.MCP_HOSTS if h[0] == "*"]

    def listed(s: Column) -> Column:
        out = F.replace(F.replace(host(s), F.lit("["), F.lit("")), F.lit("]"), F.lit("")).isin(*plain, *wild)
        for h in wild:
            out = out | host(s).endswith("." + h)
        return out

    fields = "chains signers policy mcpServers audit killSwitch oracle bridgeProvider sessionKey incident signs7702 rpcRegistry".split()
    present = F.lit(False)
    for f in fields:
        present = present | w[f].isNotNull()
    stub = m["version"].isNull() | m["version"].isin(*web3_dims.STUB_VERSIONS)
    trade = F.exists(F.coalesce(m["actions"], F.array().cast("array<string>")), lambda a: F.lower(a).isin(*web3_dims.TRADE_ACTIONS))
    delegates = [a.lower() for a in web3_dims.DELEGATES]
    return [
        one(hot & p["maxValuePerTx"].isNull(), "W01-001", signing, "critical", "Hot signer has no per-call value cap"),
        one(hot & none_or_empty(p["allowedContracts"]), "W01-002", signing, "high", "Hot signer has no contract allowlist"),
        one(hot & none_or_empty(p["allowedChains"]) & none_or_empty(w["chains"]), "W01-003", signing, "high", "Hot signer has no chain restriction"),
        one(hot & p["dailyCap"].isNull(), "W01-004", signing, "medium", "Hot signer has no aggregate daily cap"),
        one(w["signs7702"] & none_or_empty(p["allowedContracts"]) & p["expiry"].isNull(), "W03-001", "web3-eip7702-delegation", "critical", "EIP-7702 signing declared without delegate allowlist or expiry"),
        one((F.size(w["chains"]) > 0) & (F.coalesce(w["rpcRegistry"], F.lit("")) == ""), "W05-010", "web3-rpc-substitution", "low", "Manifest declares chains without an RPC registry"),
        one((F.size(w["chains"]) >= 2) & blank(w["bridgeProvider"]), "W07-001", "web3-bridge-replay", "high", "Multi-chain skill missing bridgeProvider declaration"),
        F.transform(
            F.filter(servers, lambda s: (F.coalesce(s["pinnedHash"], F.lit("")) == "") & (F.coalesce(s["pinnedVersion"], F.lit("")) == "")),
            lambda s: found("W08-001", "web3-mcp-chain-drift", "high", "MCP server declared without pinnedHash or pinnedVersion", None, None, url_of(s)),
        ),
        F.transform(
            F.filter(servers, lambda s: (F.coalesce(s["url"], F.lit("")) != "") & ~s["url"].rlike("(?i)^https?://") & ~F.trim(s["url"]).rlike(r"(?i)^(?:node|python|deno|bun|npx|uvx)\b")),
            lambda s: found("W08-002", "web3-mcp-chain-drift", "medium", "MCP server with unrecognised transport", None, None, url_of(s)),
        ),
        F.transform(
            F.filter(servers, lambda s: F.coalesce(s["url"].rlike("(?i)^https?://"), F.lit(False)) & (host(s) != "") & ~listed(s)),
            lambda s: found("W08-011", "web3-mcp-chain-drift", "low", "MCP server host not on project-recommended list", None, None, host(s)),
        ),
        one(key.isNotNull() & key["expiry"].isNull(), "W09-001", session, "high", "Session key declared without expiry"),
        one((key["expiry"] == 0) | (key["expiry"] > as_of + web3_dims.MAX_SESSION_SECONDS), "W09-002", session, "high", "Session key expiry is unbounded or beyond 7 days"),
        one(key.isNotNull() & key["valueLimit"].isNull(), "W09-003", session, "high", "Session key declared without a value limit"),
        one(key.isNotNull() & none_or_empty(key["targets"]), "W09-004", session, "high", "Session key has no target-contract allowlist"),
        one(key.isNotNull() & none_or_empty(key["selectors"]), "W09-005", session, "medium", "Session key has no function-selector allowlist"),
        one(key.isNotNull() & none_or_empty(key["chainIds"]), "W09-006", session, "medium", "Session key not pinned to specific chain IDs"),
        one(key["caveatEnforcer"].isNotNull() & ~F.lower(key["caveatEnforcer"]).isin(*delegates), "W09-007", session, "medium", "Caveat enforcer not in known allowlist"),
        one(trade & blank(w["oracle"]["source"]), "W10-010", "web3-oracle-manipulation", "high", "Trade-like actions declared without oracle source"),
        one(w["oracle"]["type"] == "spot", "W10-011", "web3-oracle-manipulation", "high", "Manifest declares spot oracle"),
        F.transform(
            F.filter(F.coalesce(m["secrets"], F.array().cast("array<struct<name:string,redactInTrace:boolean>>")), lambda s: ~F.coalesce(s["redactInTrace"], F.lit(False))),
            lambda s: found("W11-030", "web3-key-material-leak", "medium", F.concat(F.lit("Manifest secret `"), s["name"], F.lit("` missing redactInTrace")), s["name"]),
        ),
        one(present & (F.coalesce(w["audit"]["sink"], F.lit("")) == ""), "W12-001", audit, "low", "Manifest declares web3 capabilities without an audit sink"),
        one(present & (F.coalesce(w["killSwitch"]["contract"], F.lit("")) == ""), "W12-002", audit, "low", "Manifest declares web3 capabilities without a kill-switch contract"),
        one(present & (F.coalesce(w["incident"]["runbook"], F.lit("")) == ""), "W12-003", audit, "low", "Manifest declares web3 capabilities without an incident runbook"),
        one(present & stub, "W12-030", audit, "low", "Web3-capable skill is pinned to a stub version"),
        one(m["name"].rlike("(?i)-fast\\z"), "W12-040", "web3-no-user-confirmation", "high", "Skill explicitly bypasses user confirmation for state-changing transactions"),
        one(m["license"].isNull() | m["license"].isin(*web3_dims.STUB_LICENSES), "W04M-001", meta, "medium", "Web3 skill manifest is missing a license"),
        one(none_or_empty(m["permissions"]), "W04M-002", meta, "low", "Web3 skill manifest declares no permissions"),
        one(none_or_empty(m["metadataPlatforms"]), "W04M-003", meta, "low", "Web3 skill manifest has no platform-namespaced metadata block"),
        one(none_or_empty(p["allowedContracts"]), "W04M-004", meta, "medium", "Web3 skill manifest does not declare allowedContracts"),
    ]


def manifest_findings(skills: DataFrame, as_of: Column) -> DataFrame:
    """(skill_id, pattern_ord, FOUND) of all manifest rules; skills whose manifest is null have none."""
    m = F.col("manifest")
    groups = [*permission_findings(m), *instruction_findings(m), *web3_findings(m, as_of)]
    kind = f"array<struct<{', '.join(part.replace(' ', ':') for part in FOUND.split(', ')).replace(', ', ',')}>>"
    every = F.filter(F.concat(*[F.coalesce(g.cast(kind), F.array().cast(kind)) for g in groups]), lambda x: x.isNotNull())
    # no filter: it would sink below where manifests are made, and make them once more for each part of its condition
    return skills.select("skill_id", F.posexplode(F.when(m.isNotNull(), every)).alias("pattern_ord", "f")).select("skill_id", "pattern_ord", "f.*")


# ---- dependencies


def dependencies(skills: DataFrame) -> DataFrame:
    """(skill_id, name, version) of declared dependencies."""
    return skills.select("skill_id", F.explode("manifest.dependencies").alias("name", "version"))


def dependency_findings(deps: DataFrame) -> DataFrame:
    """Lookups and version rules for each declared dependency: (skill_id, pattern_ord, FOUND).

    The dimensions are constants of the package and are broadcast.
    """
    spark = deps.sparkSession
    n, v = F.col("name"), F.coalesce("version", F.lit(""))
    vulnerable = F.broadcast(spark.createDataFrame(list(dims.VULNERABLE.items()), "name string, vuln string"))
    deprecated = F.broadcast(spark.createDataFrame([(d, True) for d in dims.DEPRECATED], "name string, old boolean"))
    typos = F.broadcast(spark.createDataFrame([(t.lower(), legit) for legit, ts in dims.TYPOSQUATS.items() for t in ts], "low string, legit string"))
    rows = deps.withColumn("low", F.lower("name")).join(vulnerable, "name", "left").join(deprecated, "name", "left").join(typos, "low", "left")
    shown = F.concat(F.lit('"'), n, F.lit('": "'), v, F.lit('"'))
    named = F.concat(n, F.lit("@"), v)
    from_url = v.contains("://") | v.startswith("github:") | v.startswith("git")
    rest = r"^[a-z]+-[a-z]+-[a-z]+-[a-z]+\z|^[a-z]{1,2}-\w+|\d{3,}"
    dep = lambda test, id_, severity, title: F.when(test, found(id_, "dependencies", severity, title, n, "package.json", shown))
    supply = lambda test, id_, severity, title: F.when(test, found(id_, "supply-chain", severity, title, n, "package.json", shown))
    title = lambda text, what=n: F.concat(F.lit(text), what)
    items = F.array(
        dep(F.col("vuln").isNotNull(), "DEP-VULN", F.col("vuln"), title("Known vulnerable package: ")),
        dep(F.col("legit").isNotNull(), "DEP-TYPO", "critical", title("Potential typosquatting: ")),
        dep(F.col("legit").isNull() & ~n.startswith("@") & n.rlike(rest), "DEP-SUSP", "low", title("Suspicious package name pattern: ")),
        dep(F.col("old"), "DEP-DEPR", "low", title("Deprecated package: ")),
        dep(v.isin("*", "latest", ""), "DEP-WILD", "high", title("Unpinned dependency version: ")),
        dep(from_url | v.startswith("http"), "DEP-GIT", "high", title("Git/URL dependency: ")),
        supply(v.isin("*", "latest", "next"), "SC-PIN", "high", title("Unpinned dependency: ", named)),
        supply(v.rlike(r"^>=?\s*0(\.0(\.0)?)?\z"), "SC-WIDE", "high", title("Overly broad version range: ", named)),
        supply(v.rlike(r"^\d+\.x") | v.contains("||"), "SC-RANGE", "medium", title("Broad version range: ", named)),
        supply(from_url, "SC-GIT", "high", title("Dependency from git/URL source: ")),
        supply(from_url & ~v.rlike("#[a-f0-9]{7,}"), "SC-GIT-NOPIN", "high", title("Git dependency without commit pin: ")),
        supply(v.startswith("file:") | v.startswith("link:"), "SC-LOCAL", "low", title("Local file dependency: ")),
    )
    each = rows.select("skill_id", F.posexplode(F.array_compact(items)).alias("pattern_ord", "f")).select("skill_id", "pattern_ord", "f.*")
    count = deps.groupBy("skill_id").agg(F.countDistinct("name").alias("n")).filter("n > 30")
    text = F.col("n").cast("string")
    many = found("DEP-COUNT", "dependencies", "medium", F.concat(F.lit("Excessive dependency count ("), text, F.lit(")")), None, "package.json", F.concat(text, F.lit(" dependencies declared")))
    return each.unionByName(count.select("skill_id", F.lit(99).alias("pattern_ord"), F.inline(F.array(many))))
