"""The package from a shell: exit codes, policies, saved reports; the advice of rules."""

import json

import pytest
from pyspark.sql import functions as F

from scanloom.__main__ import main
from scanloom.functions.advice import ADVICE, explained
from scanloom.functions.dims import RULES


@pytest.fixture(scope="module")
def skills(tmp_path_factory):
    root = tmp_path_factory.mktemp("shell") / "skills"
    for name, text in {"bad/SKILL.md": "# bad\n\nText.", "bad/a.ts": "eval(req.body.x)\nconst v = 1", "good/SKILL.md": "# good\n\nText."}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_audit_ends_by_the_policy(spark, skills, tmp_path, capsys):
    out = tmp_path / "r.json"
    assert main(["audit", skills, "--format", "json", "--output", str(out)]) == 0
    data = json.loads(out.read_text())
    finding = next(f for s in data["skills"] for f in s["findings"] if f["rule"] == "injection")
    assert finding["description"] == ADVICE["injection"][0] and finding["remediation"] == ADVICE["injection"][1]
    assert main(["audit", skills, "--policy", "strict"]) == 1
    assert "Audited 2 skills" in capsys.readouterr().out
    assert main(["audit", skills, "--format", "bundle", "--output", str(tmp_path / "all")]) == 0
    assert sorted(p.suffix for p in (tmp_path / "all").iterdir()) == [".html", ".json", ".md", ".sarif", ".txt"]
    capsys.readouterr()
    for form in ("md", "html", "sarif"):
        assert main(["report", str(out), "--format", form]) == 0
        assert ADVICE["injection"][1] in capsys.readouterr().out
    assert main(["report", str(out)]) == 0 and "mean" in capsys.readouterr().out


def test_policies(tmp_path, capsys):
    assert main(["policy", "list"]) == 0 and "strict: 4 rules" in capsys.readouterr().out
    assert main(["policy", "show", "permissive"]) == 0 and "permissive" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text('{"name": "x", "rules": [{}]}')
    (tmp_path / "good.yaml").write_text("preset: strict\n")
    assert main(["policy", "validate", str(tmp_path / "bad.json")]) == 1 and "condition.type" in capsys.readouterr().err
    assert main(["policy", "validate", str(tmp_path / "good.yaml")]) == 0
    assert main(["policy", "show"]) == 2 and main(["policy", "show", "nothing"]) == 2 and main(["report", str(tmp_path / "none.json")]) == 2
    with pytest.raises(SystemExit) as stop:
        main(["audit"])
    assert stop.value.code == 2


def test_rules_and_advice(spark, capsys):
    assert main(["rules"]) == 0 and "INJ-001" in capsys.readouterr().out
    assert set(ADVICE) == {r for r, _, _ in RULES} | {"scanner-internal"}
    rows = spark.createDataFrame([("dos",), ("of a plugin",)], "rule string")
    assert {r["rule"]: r["remediation"] for r in explained(rows).collect()} == {"dos": ADVICE["dos"][1], "of a plugin": None}
    assert explained(rows).filter(F.col("description").isNull()).count() == 1


def test_an_audit_of_megabyte_lines(spark, tmp_path, capsys):
    """Literals of each quote kind, an open quote, an unbroken line and open brackets, each just below a megabyte."""
    big = 1_000_000
    lines = {"a.ts": f'const a = "{"x" * big}"', "b.ts": f"const b = '{'y' * big}'", "c.js": f"const c = `{'z' * big}`", "d.py": '"' + "a" * big, "e.py": "x" * big, "f.ts": "f(" * (big // 2), "g.py": "it's\n" * 3 + "b" * big, "h.md": "# h\n\n" + "word " * (big // 5)}
    root = tmp_path / "skills" / "big"
    root.mkdir(parents=True)
    for name, text in lines.items():
        (root / name).write_text(text)
    (root / "SKILL.md").write_text("# big\n\nText.")
    out = tmp_path / "r.json"
    assert main(["audit", str(root.parent), "--format", "json", "--output", str(out)]) == 0
    (skill,) = json.loads(out.read_text())["skills"]
    assert 0 < skill["overall"] <= 100 and skill["lines_of_code"] > 8
    assert not any(f["rule"] == "scanner-internal" for f in skill["findings"])
