"""Manifests: which file of a skill counts, its formats, and its normal form.

Each manifest becomes JSON text of one shape, so that the JVM reads it with a
schema and everything after it is expressions on a struct.  Absent keys stay
absent: an empty list and no list are different things to the rules.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.dims import MANIFEST_NAMES
from scanloom.functions.web3_dims import PLATFORMS
from scanloom.packaging import ready_for_python

WEB3_SCHEMA = (
    "STRUCT<chains: ARRAY<BIGINT>, signers: ARRAY<STRING>, policy: STRUCT<maxValuePerTx: STRING, allowedContracts: ARRAY<STRING>, "
    "allowedSelectors: ARRAY<STRING>, allowedChains: ARRAY<BIGINT>, dailyCap: STRING, expiry: BIGINT>, "
    "mcpServers: ARRAY<STRUCT<url: STRING, pinnedHash: STRING, pinnedVersion: STRING, tools: ARRAY<STRING>>>, audit: STRUCT<sink: STRING>, "
    "killSwitch: STRUCT<contract: STRING, chainId: BIGINT>, oracle: STRUCT<source: STRING, type: STRING>, bridgeProvider: STRING, "
    "sessionKey: STRUCT<expiry: BIGINT, valueLimit: STRING, targets: ARRAY<STRING>, selectors: ARRAY<STRING>, chainIds: ARRAY<BIGINT>, caveatEnforcer: STRING>, "
    "incident: STRUCT<runbook: STRING>, signs7702: BOOLEAN, rpcRegistry: STRING>"
)
MANIFEST_SCHEMA = (
    "name STRING, version STRING, description STRING, author STRING, license STRING, permissions ARRAY<STRING>, allowedTools ARRAY<STRING>, "
    "disallowedTools ARRAY<STRING>, dependencies MAP<STRING, STRING>, entrypoint STRING, hooks MAP<STRING, STRING>, actions ARRAY<STRING>, "
    f"secrets ARRAY<STRUCT<name: STRING, redactInTrace: BOOLEAN>>, tools ARRAY<STRING>, metadataText ARRAY<STRING>, metadataPlatforms ARRAY<STRING>, web3 {WEB3_SCHEMA}"
)


def parse_yaml(text: str) -> Any:
    """A plain subset of YAML: nested maps and lists, flow lists and maps, quoted and bare scalars, block text."""
    lines = [(len(raw) - len(raw.lstrip()), raw.strip()) for raw in text.replace("\t", "  ").split("\n") if raw.strip() and not raw.strip().startswith("#") and raw.strip() != "---"]
    value, _ = _yaml_block(lines, 0, lines[0][0]) if lines else ({}, 0)
    return value


def _yaml_block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[Any, int]:
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        out: Any = []
        while at < len(lines) and lines[at][0] == indent and lines[at][1][:2].strip() == "-":
            rest = lines[at][1][1:].strip()
            if re.match(r"[\w.@/-]+:(\s|$)", rest):
                # a map that begins on the dash's line
                lines[at] = (indent + 2, rest)
                value, at = _yaml_block(lines, at, indent + 2)
            elif rest:
                value, at = _yaml_scalar(rest), at + 1
            elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                value, at = _yaml_block(lines, at + 1, lines[at + 1][0])
            else:
                value, at = None, at + 1
            out.append(value)
        return out, at
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        m = re.match(r"""("[^"]*"|'[^']*'|[^:#]+?)\s*:(?:\s+(.*))?$""", lines[at][1])
        if not m:
            raise ValueError(f"not a mapping: {lines[at][1]!r}")
        key, rest = m[1].strip("\"'"), (m[2] or "").strip()
        at += 1
        if rest[:1] in ("|", ">") and len(rest) <= 2:
            part = []
            while at < len(lines) and lines[at][0] > indent:
                part.append(lines[at][1])
                at += 1
            out[key] = ("\n" if rest[0] == "|" else " ").join(part)
        elif rest:
            out[key] = _yaml_scalar(rest)
        elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
            out[key], at = _yaml_block(lines, at, lines[at][0])
        else:
            out[key] = None
    return out, at


def _yaml_scalar(text: str) -> Any:
    if text[0] in "[{":
        return _yaml_flow(text)
    if text[0] in "\"'" and text.find(text[0], 1) >= 0:
        return text[1 : text.find(text[0], 1)]
    text = re.split(r"\s+#", text)[0].strip()
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~", ""):
        return None
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _yaml_flow(text: str) -> Any:
    inner, parts, depth, quote, part = text[1 : text.rfind("]" if text[0] == "[" else "}")], [], 0, "", ""
    for c in inner:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            parts.append(part)
            part = ""
        else:
            part += c
    parts = [p.strip() for p in [*parts, part] if p.strip()]
    if text[0] == "[":
        return [_yaml_scalar(p) for p in parts]
    pairs = (p.partition(":") for p in parts)
    return {k.strip().strip("\"'"): _yaml_scalar(v.strip()) if v.strip() else None for k, _, v in pairs}


def parse_markdown(text: str) -> dict:
    """Front matter between the first two ``---``; without a description, the first paragraph that is no heading."""
    if text.startswith("---") and (end := text.find("---", 3)) > 0:
        raw = parse_yaml(text[3:end])
        if not isinstance(raw, dict):
            raise ValueError("front matter is no mapping")
        if not raw.get("description"):
            parts = [p.strip() for p in re.split(r"\n\s*\n", text[end + 3 :])]
            first = next((p for p in parts if p and not p.startswith("#")), None)
            if first:
                raw["description"] = first[:500]
        return raw
    lines = text.split("\n")
    heading = next((i for i, line in enumerate(lines) if line.startswith("# ")), None)
    if heading is None:
        raise ValueError("no heading")
    after = next((line.strip() for line in lines[heading + 1 :] if line.strip()), "")
    return {"name": lines[heading][2:].strip()} | ({"description": after} if after and not after.startswith("#") else {})


def parse_manifest(name: str, text: str) -> dict:
    """The object in a manifest file; raises ValueError where there is none."""
    base = name.rsplit("/", 1)[-1]
    raw = parse_markdown(text) if base == "SKILL.md" else parse_yaml(text) if base.endswith((".yaml", ".yml")) else json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("a manifest is an object")
    if base == "package.json":
        own = raw.get("openclaw") if isinstance(raw.get("openclaw"), dict) else raw.get("skill")
        own = own if isinstance(own, dict) else {}
        raw = {**own, **{k: raw[k] for k in ("author", "license", "dependencies") if k in raw}, **{k: own.get(k, raw.get(k)) for k in ("name", "version", "description", "main")}}
        raw.pop("web3", None) if not own.get("web3") else None
    return normal_manifest(raw)


def _texts(value: Any) -> list[str]:
    """All strings in nested objects; lists are passed over."""
    if isinstance(value, str):
        return [value]
    return [t for v in value.values() for t in _texts(v)] if isinstance(value, dict) else []


def _strings(value: Any) -> list[str] | None:
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else None


def _tools(value: Any) -> list[str] | None:
    found = _strings(value) if isinstance(value, list) else re.findall(r"[^\s,()]+(?:\([^)]*\))?", value) if isinstance(value, str) else None
    return found or None


def _record(value: Any) -> dict[str, str] | None:
    text = lambda v: v if isinstance(v, str) else json.dumps(v) if isinstance(v, (bool, dict, list, type(None))) else str(v)
    return {str(k): text(v) for k, v in value.items()} or None if isinstance(value, dict) else None


def _addresses(value: Any) -> list[str] | None:
    """A list as it is; the values of a map, flattened, each once."""
    if isinstance(value, dict):
        flat = [i for v in value.values() for i in (v if isinstance(v, list) else [v]) if isinstance(i, str)]
        return list(dict.fromkeys(flat))
    return _strings(value)


def _names(value: Any) -> list[str]:
    out = [t if isinstance(t, str) else t.get("name") for t in value if isinstance(t, (str, dict))] if isinstance(value, list) else []
    return [t for t in out if isinstance(t, str)]


def _web3(raw: dict) -> dict | None:
    metadata = raw.get("metadata") if isinstance(raw.get("metadata"), dict) else {}
    nested = [metadata[p].get("web3") for p in PLATFORMS if isinstance(metadata.get(p), dict)]
    block = next((b for b in [raw.get("web3"), *nested] if isinstance(b, dict)), None)
    if block is None:
        return None
    block = dict(block)
    if isinstance(block.get("policy"), dict):
        policy = dict(block["policy"])
        for key in ("allowedContracts", "allowedSelectors"):
            if (flat := _addresses(policy.get(key))) is not None:
                policy[key] = flat
        block["policy"] = policy
    if isinstance(block.get("mcpServers"), list):
        servers = [s if isinstance(s, dict) else {} for s in block["mcpServers"]]
        block["mcpServers"] = [{**{k: s[k] for k in ("url", "pinnedHash", "pinnedVersion") if isinstance(s.get(k), str)}, "tools": _names(s.get("tools"))} for s in servers]
    return block


def normal_manifest(raw: dict) -> dict:
    """Known keys in their types; what has another type counts as absent."""
    text = lambda k: raw[k] if isinstance(raw.get(k), str) else None
    author = raw.get("author")
    tools = lambda *keys: next((t for k in keys if (t := _tools(raw.get(k)))), None)
    metadata = raw.get("metadata") if isinstance(raw.get("metadata"), dict) else {}
    requires = raw.get("requires") if isinstance(raw.get("requires"), dict) else {}
    secrets = [s for s in raw.get("secrets") or [] if isinstance(s, dict)] if isinstance(raw.get("secrets"), list) else []
    out = {
        "name": text("name") or "unknown",
        "version": text("version") or "0.0.0",
        "description": text("description"),
        "author": author if isinstance(author, str) else author.get("name") if isinstance(author, dict) else None,
        "license": text("license"),
        "permissions": _strings(raw.get("permissions")),
        "allowedTools": tools("allowedTools", "allowed-tools"),
        "disallowedTools": tools("disallowedTools", "disallowed-tools"),
        "dependencies": _record(raw.get("dependencies")),
        "entrypoint": text("entrypoint") or text("main") or text("entry"),
        "hooks": _record(raw.get("hooks")),
        "actions": _strings(raw.get("actions")),
        "secrets": [{"name": next((s[k] for k in ("name", "id") if isinstance(s.get(k), str)), "<unnamed>"), "redactInTrace": s.get("redactInTrace") is True} for s in secrets],
        "tools": _names(requires.get("tools")),
        "metadataText": _texts(metadata),
        "metadataPlatforms": [p for p in PLATFORMS if isinstance(metadata.get(p), dict) and metadata[p]],
        "web3": _web3(raw),
    }
    return {k: v for k, v in out.items() if v is not None}


def read_manifests(files: DataFrame) -> DataFrame:
    """(skill_dir, manifest_file, manifest): the first manifest file, in their order, that parses.

    files: (skill_dir, rel_path, content).  Skills without one are not returned.
    """
    ready_for_python(files.sparkSession)
    ranked = files.filter(F.col("rel_path").isin(*MANIFEST_NAMES) & F.col("content").isNotNull()).select("skill_dir", "rel_path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for skill, path, content in zip(*(batch.column(c).to_pylist() for c in ("skill_dir", "rel_path", "content"))):
                try:
                    rows.append((skill, path, MANIFEST_NAMES.index(path), json.dumps(parse_manifest(path, content))))
                except (ValueError, KeyError, IndexError):
                    continue  # the next file in order may parse
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["skill_dir", "manifest_file", "priority", "json"])

    parsed = ranked.mapInArrow(run, "skill_dir string, manifest_file string, priority int, json string")
    first = parsed.withColumn("rn", F.row_number().over(W.partitionBy("skill_dir").orderBy("priority"))).filter("rn = 1")
    return first.select("skill_dir", "manifest_file", F.from_json("json", MANIFEST_SCHEMA).alias("manifest"))
