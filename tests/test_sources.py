"""Packages on disk: listing, contents, discovery; and checks or plugins that fail."""

import re

import pytest
from pyspark.sql import functions as F

from scanloom.operators.detectors import Detector, FileCheck, scan_files
from scanloom.operators.findings import FINDING, findings, introspect
from scanloom.sources.files import discover_all, list_files, read_files, read_package
from scanloom.sources.manifests import MANIFEST_SCHEMA
from scanloom.streaming.audits import FILES


def write(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def root(tmp_path):
    write(
        tmp_path / "skills",
        {
            "one/SKILL.md": "---\nname: one\nversion: 1.0.0\n---\nText.\n", "one/latin.py": "# caf\u00e9\neval(x)\n".encode("latin-1"), "one/.github/flow.yml": "a: 1", "one/.env.txt": "x", "one/.git/config": "x",
            "one/src/node_modules/m.js": "x", "one/src/a.ts": "eval(x)", "one/nul.bin": b"a\0b", "one/empty.ts": "", "one/big.txt": b"x" * ((1 << 20) + 1), "one/edge.txt": b"x" * (1 << 20), "one/.gitignore": "*.log\n", "one/b.log": "x",
            "@s/two/SKILL.md": "---\nname: two\nversion: 2.0.0\n---\n", "bare/x.txt": "no manifest", "loose.txt": "x", ".hid/SKILL.md": "x",
        },
    )
    return tmp_path / "skills"


def test_files_of_a_root(spark, root):
    got = {(r["skill_dir"].split("/skills/")[1], r["rel_path"]): r for r in read_files(spark, [str(root)]).collect()}
    one = {p for s, p in got if s == "one"}
    assert one == {"SKILL.md", "latin.py", ".github/flow.yml", ".env.txt", "src/a.ts", "edge.txt", ".gitignore"}
    assert {s for s, _ in got} == {"one", "@s/two", "bare"}
    assert got["one", "latin.py"]["content"] == "# caf\ufffd\neval(x)\n" and got["one", "latin.py"]["language"] == "python"


def test_shallow_reads_nothing(spark, root):
    (root / "one/src/a.ts").chmod(0)
    got = read_files(spark, [str(root)], shallow=True).collect()
    assert {r["content"] for r in got} == {None} and {"b.log", "src/a.ts"} <= {r["rel_path"] for r in got}
    assert read_files(spark, [str(root / "nowhere")]).count() == 0 and read_files(spark, []).count() == 0


def test_roots_that_overlap_count_once(spark, root):
    for roots in ([root, root / "@s"], [root / "@s", root], [root, f"{root}/"]):
        got = [(r["skill_dir"], r["rel_path"]) for r in read_files(spark, [*map(str, roots)]).collect()]
        assert len(got) == len(set(got)) and {d.split("/skills/")[1] for d, _ in got} == {"one", "@s/two", "bare"}


def test_contents_are_in_no_exchange(spark, root):
    _, files = read_package(spark, [str(root)])
    plan = files._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange.*", plan)
    assert exchanges and "content" in plan and not any("content" in e for e in exchanges)
    # from the last exchange of paths on, contents go straight to the output
    top = plan[: plan.index("Exchange")]
    assert top.count("MapInArrow") == 1
    assert {r["skill_id"] for r in files.collect()} == {"one@1.0.0", "two@2.0.0"}


def test_discovery_of_all_platforms(spark, root, tmp_path):
    work, home = tmp_path / "work", tmp_path / "home"
    write(work, {"a/b/skills/near/SKILL.md": "x", "a/b/c/skills/far/SKILL.md": "x", "node_modules/skills/no/SKILL.md": "x", ".claude/skills/mine/SKILL.md": "x", ".other/skills/no/SKILL.md": "x"})
    write(home, {".openclaw/workspace-7/skills/wild/SKILL.md": "x", ".codex/skills/no/SKILL.md": "x", ".agents/skills/agent/SKILL.md": "x", ".claude/plugins/p/skills/q/inner/SKILL.md": "x"})
    got = {r["skill_dir"].rsplit("/", 1)[1]: r["platform"] for r in discover_all(spark, str(work), str(home), [str(root)], shallow=True).collect()}
    assert set(got) == {"near", "mine", "wild", "agent", "inner", "one", "two", "bare"}
    assert got["mine"] == "claude" and got["wild"] == "openclaw" and got["near"] is None


def skill_frame(spark):
    return spark.createDataFrame([("s", "{}"), ("t", "{}")], "skill_id string, json string").select("skill_id", F.from_json("json", MANIFEST_SCHEMA).alias("manifest"))


def test_a_check_that_raises_is_a_finding(spark):
    def fails(src):
        raise ZeroDivisionError("no")

    rows = [("s", 0, "a.ts", "eval(x)", "typescript", 7), ("s", 0, "b.ts", "eval(x)", "typescript", 7), ("t", 0, "c.md", "x", "markdown", 1)]
    files = spark.createDataFrame(rows, FILES)
    extra = [FileCheck("X-1", "injection", fails, frozenset(["ts"])), Detector("X-2", "storage", "low", "T", "eval", where=(lambda src, m: 1 / 0,), extensions=frozenset(["ts"]))]
    got = findings(skill_frame(spark), files, web3=False, extra=extra).collect()
    failed = [r for r in got if r["id"].startswith("SCANNER-ERR-")]
    assert sorted((r["skill_id"], r["id"], r["rule"], r["severity"], r["category"], r["owasp_id"]) for r in failed) == [("s", f"SCANNER-ERR-{r}", "scanner-internal", "info", "skill-injection", None) for r in ("injection", "storage")]
    assert sum(r["detector"] == "INJ-001" for r in got) == 2
    assert scan_files(files, extra).count() == 4


def test_a_plugin_that_raises_is_passed_over(spark):
    files = spark.createDataFrame([("s", 0, "a.ts", "eval(x)", "typescript", 7)], FILES)
    skills = skill_frame(spark)

    def fails(skills, files):
        raise RuntimeError("no")

    def unfit(skills, files):
        return skills.select(F.col("nowhere"))

    def adds(skills, files):
        return skills.select("skill_id", F.lit("P-1").alias("id"), F.lit("plugin").alias("rule"), F.lit("low").alias("severity"))

    got = findings(skills, files, web3=False, plugins=[("a", fails), ("b", unfit), ("c", adds)])
    assert got.columns == FINDING and got.filter("id = 'P-1'").count() == 2 and got.filter("detector = 'INJ-001'").count() == 1


def test_introspection():
    rules = introspect()
    assert len(rules) == 25 and len(introspect(web3=False)) == 11
    assert "INJ-001" in next(r for r in rules if r["rule"] == "injection")["detectors"]
