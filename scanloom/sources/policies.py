"""Policies and settings from JSON or YAML files; read on the driver, as they are small."""

from __future__ import annotations

import json
from pathlib import Path

from scanloom.operators.policy import PRESETS, PolicyRule, policy_errors
from scanloom.sources.manifests import parse_yaml

SETTINGS_NAMES = (".scanloomrc", ".scanloomrc.json", "scanloom.config.json")


def parse_policy(text: str, kind: str = "json") -> tuple[str, list[PolicyRule]]:
    """A policy's name and rules; ``preset`` alone names one; raises ValueError with all errors."""
    raw = json.loads(text) if kind == "json" else parse_yaml(text)
    if isinstance(raw, dict) and isinstance(raw.get("preset"), str) and not raw.get("rules"):
        if raw["preset"] not in PRESETS:
            raise ValueError(f"unknown preset {raw['preset']!r}")
        return raw["preset"], PRESETS[raw["preset"]]
    if errors := policy_errors(raw):
        raise ValueError("; ".join(errors))
    return raw["name"], [PolicyRule(r["id"], r.get("description", ""), r["severity"], r["action"], r["condition"]["type"], r["condition"].get("value") or {}) for r in raw["rules"]]


def load_policy(name_or_path: str) -> tuple[str, list[PolicyRule]]:
    """A preset by name, or a policy file."""
    if name_or_path in PRESETS:
        return name_or_path, PRESETS[name_or_path]
    path = Path(name_or_path)
    return parse_policy(path.read_text(), "yaml" if path.suffix in (".yml", ".yaml") else "json")


def find_settings(start: str | Path) -> dict:
    """The first settings file in a folder or up to ten above it; an empty dict if there is none."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:11]:
        for name in SETTINGS_NAMES:
            if (folder / name).is_file():
                return json.loads((folder / name).read_text())
    return {}
