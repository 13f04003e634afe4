"""The package from a shell.

    python -m scanloom audit DIR... [--profile P] [--policy NAME|FILE] [--format F] [--output FILE|DIR]
    python -m scanloom report FILE --format F
    python -m scanloom policy list | show NAME | validate FILE
    python -m scanloom rules

Ends with 0, with 1 if the policy blocks a skill or a policy file is not valid,
and with 2 if it was called wrongly.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from scanloom.operators.policy import PRESETS
from scanloom.plans.reports import FORMATS, console, render, write_bundle
from scanloom.sources.policies import find_settings, load_policy, parse_policy


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="scanloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit", help="audit the skills below folders")
    audit.add_argument("paths", nargs="+")
    audit.add_argument("--profile", choices=("default", "web3", "strict"))
    audit.add_argument("--policy", help="a preset or a policy file")
    audit.add_argument("--format", choices=(*FORMATS, "bundle", "console"))
    audit.add_argument("--output", help="a file, or a folder for a bundle; the terminal if not given")
    audit.add_argument("--limit", type=int, help="findings shown for a skill")
    audit.add_argument("--verbose", action="store_true")
    report = commands.add_parser("report", help="show a saved JSON report in another format")
    report.add_argument("file")
    report.add_argument("--format", choices=tuple(FORMATS), default="text")
    policy = commands.add_parser("policy", help="list, show and check policies")
    policy.add_argument("action", choices=("list", "show", "validate"))
    policy.add_argument("name", nargs="?")
    commands.add_parser("rules", help="list the rules and their detectors")
    return parser


def _audit(options: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from scanloom.plans.audit import audit
    from scanloom.sources.files import read_package

    settings = find_settings(".")
    chosen = lambda name, otherwise=None: getattr(options, name) or settings.get(name) or otherwise
    policy = load_policy(chosen("policy")) if chosen("policy") else None
    spark = SparkSession.builder.appName("scanloom").getOrCreate()
    skills, files = read_package(spark, options.paths)
    run = audit(skills, files, chosen("profile", "default"), policy)
    form = chosen("format", "console")
    if form == "bundle":
        failed = write_bundle(run, options.output or "reports", options.limit)
        for name, why in failed.items():
            print(f"{name}: {why}", file=sys.stderr)
    else:
        text = console(run, options.verbose, sys.stdout.isatty()) if form == "console" else render(run, form, options.limit)
        Path(options.output).write_text(text) if options.output else print(text)
    blocked = run.violations.filter("action = 'block'").limit(1).count()
    run.release()
    return int(blocked > 0)


def _report(options: argparse.Namespace) -> int:
    data = json.loads(Path(options.file).read_text())
    if not isinstance(data, dict) or not {"skills", "summary"} <= set(data):
        raise ValueError("a report has skills and a summary")
    print(FORMATS[options.format](data))
    return 0


def _policy(options: argparse.Namespace) -> int:
    if options.action == "list":
        for name, rules in PRESETS.items():
            print(f"{name}: {len(rules)} rules")
        return 0
    if not options.name:
        raise ValueError(f"policy {options.action} needs a name")
    if options.action == "validate":
        path = Path(options.name)
        try:
            name, rules = parse_policy(path.read_text(), "yaml" if path.suffix in (".yml", ".yaml") else "json")
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
        print(f"{name} is valid: {len(rules)} rules")
        return 0
    name, rules = load_policy(options.name)
    print(name)
    for r in rules:
        print(f"  {r.id} ({r.severity}, {r.action}): {r.description or r.type}")
    return 0


def _rules(options: argparse.Namespace) -> int:
    from scanloom.operators.findings import introspect

    for r in introspect():
        print(f"{r['rule']} ({r['owasp_id']}, {r['category']}): {' '.join(r['detectors']) or 'manifest and skill checks'}")
    return 0


def main(arguments: list[str] | None = None) -> int:
    options = _arguments().parse_args(arguments)
    try:
        return {"audit": _audit, "report": _report, "policy": _policy, "rules": _rules}[options.command](options)
    except (OSError, ValueError) as error:
        print(f"scanloom: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
