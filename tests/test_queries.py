"""Queries against DuckDB, on a small scale factor if it is there; and the entry module without the training-data part."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scanloom.functions.source import Source
from scanloom.operators.detectors import FileCheck, count_hits, scan_files
from scanloom.operators.findings import detectors
from scanloom.operators.manifest_rules import manifest_findings
from scanloom.operators.skill_rules import BY_SUFFIX
from scanloom.plans.registry import QUERIES, SQL
from scanloom.plans.rule_findings import CUT, WAYS, reported
from scanloom.plans.rule_queries import RULE_FILES
from scanloom.plans.rule_tables import KINDS, ROWS, TEXTS
from scanloom.sources.manifests import MANIFEST_SCHEMA

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
REPO = Path(__file__).resolve().parents[1]


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(found, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    names = want.columns
    assert rows([r.asDict() for r in got.collect()], columns) == rows([dict(zip(names, r)) for r in want.fetchall()], columns)


def test_redaction_reaches_every_document(spark, tmp_path):
    key = "9233A8ECF7C5B09FE594"
    texts = [f'token = "{key}"', f'TOKEN = "{key}"', f"token: '{key}'", f'x "{key}" y', "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in QUERIES["secret_token_redact_all"](spark, str(tmp_path)).collect()}
    assert got == {i: t and t.replace(key, "[REDACTED]") for i, t in enumerate(texts)}


def test_complexity_has_every_branch_kind(spark, tmp_path):
    text = "if a:\n  pass\nelif b and c:\n  pass\nelse:\n  x = 1 if y else 2\ntry:\n  pass\nexcept E:\n  pass\nfinally:\n  pass\nwhile z or w:\n  for i in r: pass\n"
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = QUERIES["complexity_counts_all"](spark, str(tmp_path)).collect()
    want = {"if": 2, "elif": 1, "else": 1, "for": 1, "while": 1, "try": 1, "catch": 1, "finally": 1, "ternary": 1, "logical-and": 1, "logical-or": 1}
    assert {k: got[k] for k in want} == want and got["weighted"] == 11.1


@pytest.mark.parametrize("rule", sorted(ROWS))
def test_rule_findings_come_from_every_detector_and_piece(spark, tmp_path, rule):
    # pieces enough for each line in each way and kind of file
    count = len(TEXTS[rule]) * len(WAYS) * len(KINDS)
    docs = [(i, CUT.join(f"piece {k}\n{TEXTS[rule][0]} {k}" for k in range(31)), "s") for i in range(6 * count // 31 + 1)]
    spark.createDataFrame([*docs, (1 << 40, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["rule_" + rule.replace("-", "_")](spark, str(tmp_path)).collect()
    assert {r["detector"] for r in got} == {row[0] for row in ROWS[rule]}
    assert {r["rel_path"].rsplit("-", 1)[1].split(".")[0] for r in got} == set(map(str, range(31)))


def test_counted_hits_equal_hits(spark):
    lines = [f.expression for r in RULE_FILES.values() for f in r.finds] + [t for ts in TEXTS.values() for t in ts] + ["import x from 'left-pad'", "// eval(x)", "lookupAddress(x)"]
    held = [d for d in detectors(True)]
    files = [(f"s{k % 2}", f"{k}.{e}", t) for e in ("ts", "py", "md") for k, t in enumerate([*lines, "\n".join(lines), "", None])]
    df = spark.createDataFrame(files, "skill_id string, rel_path string, content string")

    def broken(src):
        raise ValueError("no")

    held.append(FileCheck("X-1", "x", broken))
    key = ["skill_id", "detector", "suffix", "severity"]
    hits = [r.asDict() for r in scan_files(df.withColumn("file_ord", F.lit(0).cast("long")), held).select(*key).collect()]
    want = Counter(tuple(h[c] if c != "suffix" or h["detector"] in BY_SUFFIX else None for c in key) for h in hits)
    for most in (20_000, 3):
        assert {tuple(r[c] for c in key): r["n"] for r in count_hits(df, held, BY_SUFFIX, most).collect()} == want
    assert want[("s0", "DEP-UNDECL", "left-pad", "medium")] > 0 and len(want) > 200


@pytest.mark.parametrize("name", ["rule_storage", "rule_web3_key_material_leak"])
def test_files_of_rules_are_made_once(spark, tmp_path, name):
    """A test for nulls below the scan made Spark work out paths and contents a second time."""
    spark.createDataFrame([(1, "a the b", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("concat(" in line or "replace(" in line)]


@pytest.mark.parametrize("rule", sorted(ROWS))
def test_detectors_left_out_report_nothing_that_a_query_does(rule):
    said, ran = {row[0] for row in ROWS[rule]}, {d.id for d in reported(rule)}
    out = [d for d in detectors(True) if d.rule == rule and d.id not in ran]
    files = [Source(f"a.{kind}", "\n".join([*TEXTS[rule], "automatically trades for you", "const x = req.body", "exec(x)"])) for kind in KINDS]
    assert not {h.detector for d in out for src in files for h in d.hits(src)} & said
    assert not ran & {"W01-020", "W07-003", "W07-004", "W07-005", "INJ-050"}


def test_null_paths_and_contents_have_no_hits(spark):
    files = spark.createDataFrame([("s", 0, "a.ts", None), ("s", 1, None, "eval(x)"), ("s", 2, "b.ts", "eval(x)")], "skill_id string, file_ord long, rel_path string, content string")
    held = [d for d in detectors(True) if d.id == "INJ-001"]
    assert [r["file_ord"] for r in scan_files(files, held).collect()] == [2]
    assert [r["n"] for r in count_hits(files, held).collect()] == [1]


def test_a_file_is_searched_once_for_what_it_must_lack():
    src = Source("a.ts", "e.resolveName(n)\n" * 500)
    (d,) = (d for d in detectors(True) if d.id == "W06-003")
    assert len(list(d.hits(src))) == 500 and len(src._held) == 1


def test_manifests_are_made_once_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = QUERIES["manifest_rules"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter " not in plan and "Repartition 48, true" in plan
    skills = spark.createDataFrame([("a", '{"name": "x-fast"}'), ("b", None)], "skill_id string, json string").select("skill_id", F.from_json("json", MANIFEST_SCHEMA).alias("manifest"))
    assert {r["skill_id"] for r in manifest_findings(skills, F.lit(0)).collect()} == {"a"}


def test_entry_module_without_the_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(REPO), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "scanloom/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('scanloom.plans.queries').plans.queries.QUERIES))"], cwd=copy, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
