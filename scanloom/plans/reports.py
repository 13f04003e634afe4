"""Reports of an audit: JSON, SARIF, Markdown, HTML, text and CSV.

What a report shows is one nested row per skill, built on the cluster; only the
formats for people are put together on the driver, from findings that the
caller bounds by ``limit`` per skill where a run is large.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.advice import explained
from scanloom.functions.dims import SEVERITIES
from scanloom.operators.scoring import half_up
from scanloom.operators.summary import best_and_worst, dense_matrix, matrix_cells, rule_number, top_findings, worst_skills
from scanloom.plans.audit import Audit

RANK = {name: rank for name, rank, *_ in SEVERITIES}
LEVEL = {name: level for name, _, _, level, _ in SEVERITIES}
CVSS = {name: cvss for name, *_, cvss in SEVERITIES}
SHOWN = ["id", "rule", "severity", "category", "title", "rel_path", "line", "evidence", "owasp_id", "description", "remediation"]


def report_rows(audit: Audit, limit: int | None = None) -> DataFrame:
    """One row per skill: scores, metrics, findings in severity order, violations, recommendations.

    limit: findings shown for a skill; all if not given.
    """
    order = W.partitionBy("skill_id").orderBy("severity_rank", "file_ord", "rel_path", "rule", "pattern_ord", "at")
    ranked = explained(audit.findings).withColumn("n", F.row_number().over(order))
    ranked = ranked.filter(F.col("n") <= limit) if limit else ranked
    lists = lambda df, fields, name, key: df.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct(key, *fields))).alias(name))
    out = audit.scores.join(audit.metrics, "skill_id").join(audit.skills.select("skill_id", F.col("manifest.description").alias("description")), "skill_id")
    out = out.join(lists(ranked, SHOWN, "findings", "n"), "skill_id", "left")
    out = out.join(lists(audit.violations, ["policy", "severity", "message", "action"], "violations", "rule_id"), "skill_id", "left")
    out = out.join(lists(audit.recommendations, ["category", "priority", "title", "description", "effort"], "recommendations", "ord"), "skill_id", "left")
    return out.join(audit.web3, "skill_id", "left").orderBy("skill_id")


def _plain(row) -> dict:
    return json.loads(json.dumps(row.asDict(recursive=True), default=str))


def collected(audit: Audit, limit: int | None = None) -> dict:
    """The report as plain data, on the driver."""
    skills = [_plain(r) for r in report_rows(audit, limit).collect()]
    for s in skills:
        for k in ("findings", "violations", "recommendations"):
            s[k] = s[k] or []
    made = {"report_id": str(uuid.uuid4()), "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    return {**made, "summary": _plain(audit.summary.first()) | _plain(audit.web3_summary.first()), "skills": skills}


def comparison(audit: Audit) -> dict:
    """Rules by skills: worst severity and count in each cell, skills by score, rules by number."""
    cells = [_plain(r) for r in dense_matrix(audit.findings, audit.skills).orderBy(rule_number(F.col("rule_key")), "rule_key").collect()]
    order = [r["skill_id"] for r in audit.scores.orderBy(F.desc("overall"), "skill_id").select("skill_id").collect()]
    rules: dict[str, dict] = {}
    for c in cells:
        rules.setdefault(c["rule_key"], {})[c["skill_id"]] = {"severity": c["worst"], "count": c["n"]}
    mean = audit.scores.agg(half_up(F.avg("overall")).cast("int").alias("average")).first()["average"]
    return {"skills": order, "rules": rules, "average": mean, **_plain(best_and_worst(audit.scores).first())}


def write_findings(audit: Audit, path: str) -> None:
    """All findings as JSON lines, from the executors."""
    explained(audit.findings).drop("at", "pattern_ord", "file_ord").write.json(path)


def write_sarif_results(audit: Audit, path: str) -> None:
    """All SARIF results as JSON lines, from the executors: as in as_sarif, without the index of the rule."""
    level = F.create_map(*[F.lit(x) for pair in LEVEL.items() for x in pair])
    line = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("rel_path").alias("uri")).alias("artifactLocation"), line.alias("region")).alias("physicalLocation"))
    audit.findings.select(
        F.coalesce("owasp_id", "rule").alias("ruleId"), F.element_at(level, F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.struct(F.concat_ws("/", "skill_id", "id").alias("finding")).alias("partialFingerprints"), F.when(F.coalesce("rel_path", F.lit("")) != "", F.array(place)).alias("locations"),
    ).write.json(path)


def matrix_csv(audit: Audit, path: str) -> None:
    """(skill, rule_id, severity, count) with a header, from the executors."""
    cells = matrix_cells(audit.findings, with_info=True).select(F.col("skill_id").alias("skill"), F.col("rule_key").alias("rule_id"), F.col("worst").alias("severity"), F.col("n").alias("count"))
    cells.write.option("header", True).csv(path)


# ---- formats


def as_json(data: dict) -> str:
    return json.dumps(data, indent=2)


def rule_title(key: str) -> str:
    """A slug as one word with capitals."""
    return "".join(p.capitalize() for p in re.split("[-_]", key) if p)


def as_sarif(data: dict) -> str:
    """SARIF 2.1.0; rules by risk id, else rule, the first finding naming each; results point at their rule."""
    rules: dict[str, dict] = {}
    results, number = [], {}
    for skill in data["skills"]:
        for f in skill["findings"]:
            key = f["owasp_id"] or f["rule"]
            if key not in rules:
                number[key] = len(rules)
                about, advice = f.get("description") or f["title"], f.get("remediation") or ""
                rules[key] = {
                    "id": key, "name": rule_title(f["rule"]), "shortDescription": {"text": f["title"]}, "fullDescription": {"text": about}, "help": {"text": advice or about, "markdown": advice or about}, "defaultConfiguration": {"level": LEVEL[f["severity"]]},
                    "properties": {"security-severity": CVSS[f["severity"]], "tags": ["security", f["category"]]},
                }
            result = {"ruleId": key, "ruleIndex": number[key], "level": LEVEL[f["severity"]], "message": {"text": f["title"]}, "partialFingerprints": {"finding": f"{skill['skill_id']}/{f['id']}"}}
            if f["rel_path"]:
                place = {"artifactLocation": {"uri": f["rel_path"]}}
                if f["line"]:
                    place["region"] = {"startLine": f["line"]}
                result["locations"] = [{"physicalLocation": place}]
            results.append(result)
    run = {"tool": {"driver": {"name": "scanloom", "rules": list(rules.values())}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


def _cell(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def _place(f: dict) -> str:
    return f"{f['rel_path']}:{f['line']}" if f["rel_path"] and f["line"] else f["rel_path"] or ""


def as_markdown(data: dict) -> str:
    s = data["summary"]
    out = ["# Audit report", "", f"{s['total_skills']} skills, mean score {s['average_score']}, {s['total_findings']} findings, {s['blocked_skills']} blocked.", ""]
    for k in data["skills"]:
        out += [f"## {k['skill_id']}", "", f"Grade {k['grade']} ({k['overall']}): security {k['security']}, quality {k['quality']}, maintenance {k['maintenance']}.", ""]
        if k["findings"]:
            out += ["| Severity | Finding | Place |", "| --- | --- | --- |"]
            out += [f"| {f['severity']} | {_cell(f['title'])} | {_cell(_place(f))} |" for f in k["findings"]]
            out += ["", *[f"- {rule}: {about} {advice}" for rule, (about, advice) in explanations(k).items()], ""]
        out += [f"- {v['action']}: {v['message']}" for v in k["violations"]] + [f"- {r['priority']}: {r['title']}" for r in k["recommendations"]] + [""]
    return "\n".join(out)


def comparison_markdown(view: dict) -> str:
    names = view["skills"]
    out = ["| Rule | " + " | ".join(map(_cell, names)) + " |", "| --- " * (len(names) + 1) + "|"]
    for key, cells in view["rules"].items():
        out.append(f"| {_cell(key)} | " + " | ".join(f"{cells[n]['severity']} ({cells[n]['count']})" if cells[n]["count"] else "pass" for n in names) + " |")
    return "\n".join(out)


PRIORITIES = ("critical", "high", "medium", "low")
#: Metrics that pages show, and how.
SHOWN_METRICS = {
    "code_complexity": "complexity {:.1f}", "test_coverage": "test coverage {:.0f}%", "documentation_score": "documentation {:.0%}", "maintenance_health": "maintenance {:.0f}",
    "lines_of_code": "{:.0f} lines of code", "dependency_count": "{:.0f} dependencies", "outdated_dependencies": "{:.0f} outdated",
}


def advice_by_priority(skill: dict) -> dict[str, list[dict]]:
    """Recommendations under their priorities, the most pressing first; priorities without any are left out."""
    own = {p: [r for r in skill["recommendations"] if r["priority"] == p] for p in PRIORITIES}
    return {p: rows for p, rows in own.items() if rows}


def shown_metrics(skill: dict) -> list[str]:
    """The metrics that are known, as text."""
    return [form.format(skill[k]) for k, form in SHOWN_METRICS.items() if skill.get(k) is not None]


def explanations(skill: dict) -> dict[str, tuple[str, str]]:
    """Description and remediation of the rules that a skill has findings of, in the order of the findings."""
    return {f["rule"]: (f["description"], f["remediation"] or "") for f in skill["findings"] if f.get("description")}


def as_html(data: dict) -> str:
    e = html.escape
    rows = "".join(f"<tr><td>{e(k['skill_id'])}</td><td>{k['grade']}</td><td>{k['overall']}</td><td>{len(k['findings'])}</td></tr>" for k in data["skills"])
    parts = []
    for k in data["skills"]:
        items = "".join(f"<tr class='{f['severity']}'><td>{f['severity']}</td><td>{e(f['title'])}</td><td>{e(_place(f))}</td><td><code>{e(f['evidence'] or '')}</code></td></tr>" for f in k["findings"])
        advice = "".join(f"<h3>{p}</h3><ul>" + "".join(f"<li>{e(r['title'])}: {e(r['description'] or '')}</li>" for r in own) + "</ul>" for p, own in advice_by_priority(k).items())
        broken = "".join(f"<li>{e(v['action'])}: {e(v['message'])}</li>" for v in k["violations"])
        measured = "".join(f"<li>{e(m)}</li>" for m in shown_metrics(k))
        scores = f"security {k['security']}, quality {k['quality']}, maintenance {k['maintenance']}"
        about = "".join(f"<dt>{e(rule)}</dt><dd>{e(text)} {e(fix)}</dd>" for rule, (text, fix) in explanations(k).items())
        parts.append(f"<section><h2>{e(k['skill_id'])}</h2><p>{e(k.get('description') or '')}</p><p>{scores}</p><ul class='metrics'>{measured}</ul><table>{items}</table><dl>{about}</dl><ul>{broken}</ul>{advice}</section>")
    s = data["summary"]
    head = f"<p>{s['total_skills']} skills, mean score {s['average_score']}, {s['total_findings']} findings, {s.get('web3_skills', 0)} about web3</p><p>{data.get('report_id', '')} {data.get('generated_at', '')}</p>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Audit report</title></head><body><h1>Audit report</h1>{head}<table>{rows}</table>{''.join(parts)}</body></html>"


def comparison_html(view: dict) -> str:
    e, names = html.escape, view["skills"]
    head = "".join(f"<th>{e(n)}</th>" for n in names)
    body = "".join(f"<tr><th>{e(k)}</th>" + "".join(f"<td class='{c[n]['severity']}'>{c[n]['count'] or 'pass'}</td>" for n in names) + "</tr>" for k, c in view["rules"].items())
    return f"<table><tr><th></th>{head}</tr>{body}</table>"


#: Terminal colours of severities and priorities.
COLOURS = {"critical": "1;31", "high": "31", "medium": "33", "low": "36", "info": "2"}
_CODES = re.compile("\x1b\\[[0-9;]*m")


def painted(text: str, severity: str, colour: bool) -> str:
    return f"\x1b[{COLOURS.get(severity, '0')}m{text}\x1b[0m" if colour else text


def padded(text: str, width: int) -> str:
    """Text filled up to a width that colour codes take no part of."""
    return text + " " * max(0, width - len(_CODES.sub("", text)))


def gauge(score: int, steps: int = 10) -> str:
    return "#" * (score * steps // 100) + "." * (steps - score * steps // 100)


def as_text(data: dict, colour: bool = False, shown: int = 5) -> str:
    """For terminals: totals, then each skill with its first findings and its recommendations by priority."""
    s = data["summary"]
    out = [f"Skills {s['total_skills']}  mean {s['average_score']}  findings {s['total_findings']}  blocked {s['blocked_skills']}  certified {s['certified_skills']}"]
    if s.get("web3_skills"):
        out.append(f"Web3 {s['web3_skills']} skills  {s['web3_critical']} critical findings")
    for k in data["skills"]:
        out.append(f"{k['grade']} [{gauge(k['overall'])}] {k['overall']:>3}  {k['skill_id']}  documentation {round(k['documentation_score'] * 100)}%")
        out += [f"    {padded(painted(f['severity'], f['severity'], colour), 8)} {f['title']}  {_place(f)}".rstrip() for f in k["findings"][:shown]]
        for p, own in advice_by_priority(k).items():
            out.append(f"    {painted(p, p, colour)}")
            out += [f"      * {r['title']}" for r in own]
    return "\n".join(out)


def console(audit: Audit, verbose: bool = False, colour: bool = False, shown: int = 5) -> str:
    """What a terminal shows after a run: the skills with most critical findings; verbose adds the first findings of every skill.

    Only what is shown is collected.
    """
    s = _plain(audit.summary.first())
    out = [f"Audited {s['total_skills']} skills: mean score {s['average_score']}, {s['total_findings']} findings, {s['blocked_skills']} blocked"]
    out += [f"  {painted(r['skill_id'], 'critical', colour)}  {r['critical']} critical" for r in worst_skills(audit.findings).collect()]
    if verbose:
        last = None
        for r in top_findings(audit.findings, shown).orderBy("skill_id", "rn").toLocalIterator():
            out += [] if r["skill_id"] == last else [r["skill_id"]]
            out.append(f"    {padded(painted(r['severity'], r['severity'], colour), 8)} {r['title']}")
            last = r["skill_id"]
    return "\n".join(out)


def as_csv(view: dict) -> str:
    """The comparison's cells that have findings."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["skill", "rule_id", "severity", "count"])
    w.writerows([n, k, c[n]["severity"], c[n]["count"]] for k, c in view["rules"].items() for n in view["skills"] if c[n]["count"])
    return out.getvalue()


FORMATS: dict[str, Callable[[dict], str]] = {"json": as_json, "sarif": as_sarif, "md": as_markdown, "html": as_html, "text": as_text}
SUFFIX = {"json": "json", "sarif": "sarif", "md": "md", "html": "html", "text": "txt"}


def render(audit: Audit, format_: str, limit: int | None = None) -> str:
    """The report in one format; JSON has the comparison as well if there are two skills or more."""
    if format_ not in FORMATS:
        raise ValueError(f"format is none of {', '.join(FORMATS)}")
    data = collected(audit, limit)
    if format_ == "json" and len(data["skills"]) > 1:
        data["comparison"] = comparison(audit)
    return FORMATS[format_](data)


def write_bundle(audit: Audit, folder: str, limit: int | None = None) -> dict[str, str]:
    """All formats into a folder; returns what failed, by format, while the others are written."""
    data = collected(audit, limit)
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(name: str) -> str | None:
        try:
            (Path(folder) / f"report.{SUFFIX[name]}").write_text(FORMATS[name](data))
        except (OSError, ValueError, KeyError, TypeError) as error:
            return str(error)
        return None

    with ThreadPoolExecutor(len(FORMATS)) as pool:
        failed = dict(zip(FORMATS, pool.map(write, FORMATS)))
    return {name: why for name, why in failed.items() if why is not None}
