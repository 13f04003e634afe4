"""The linear lexer against the expressions that it stands for, and texts that those cannot take; the literals of expressions."""

import random
import re
import time

import pytest

from scanloom.functions import lexer
from scanloom.functions.dialect import python_pattern
from scanloom.functions.literals import FEW, Finder, Prefilter, beginnings, required
from scanloom.functions.web3_patterns import WEB3
from scanloom.operators import measures
from scanloom.operators.detectors import FileCheck, Scanner
from scanloom.operators.findings import detectors
from scanloom.plans.rule_tables import TEXTS

ANY = r"[^\n\r  ]"
QUOTED = [(r"`(?:[^`\\]|\\" + ANY + ")*`", '""'), (r'"(?:[^"\\]|\\' + ANY + ')*"', '""'), (r"'(?:[^'\\]|\\" + ANY + ")*'", "''")]
STRIPS = {
    "js": [(r"(?s)/\*.*?\*/", ""), (r"//[^\n]*", ""), *QUOTED],
    "python": [(r'(?s)""".*?"""', '""'), (r"(?s)'''.*?'''", "''"), (r"#[^\n]*", ""), *QUOTED[1:]],
}
FUNCTION = r"\b(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>|(?:async\s+)?(?:get|set|static)?\s*(?:[a-zA-Z_]\w*)\s*\([^)]*\)\s*[:{])"
DOCSTRING = r'''(?:def|class)\s+\w+[^:]*:\s*\n\s*(?:""".*?"""|\'\'\'.*?\'\'\')'''
PARTS = [
    '"', "'", "`", "\\", "\\\\", "\\\n", "/*", "*/", "//", "#", '"""', "'''", "\n", " ", "  ", "if", "else", "for", "(", ")", "in", "of", "a", "x y", "for (", "for(", "for (a in b)", "def f", "class C", ":", "{", "=>",
    "const x = ", "async ", "get ", "set", "static", "function", " ", "﻿", "async (x) {", "foo(a) {", "const f = (a) =>", "const f = async b =>", "return ", "x if y else z ", "else ", "if ", "def g():\n  '''d'''",
    "def g(a,\n b): \n \"\"\"", "\x85", "_", "1",
]


def replaced(text, kind):
    for pattern, put in STRIPS[kind]:
        text = re.sub(pattern, put, text)
    return text


def count(pattern, text, flags=""):
    return len(python_pattern(pattern, flags).findall(text))


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_expressions(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 25)))
        assert lexer.stripped(t, "js") == replaced(t, "js")
        assert lexer.stripped(t, "python") == replaced(t, "python")
        assert lexer.count_heads(t, "in") == count(r"\bfor\s*\([^)]*\bin\b", t)
        assert lexer.count_ternaries(t) == count(r"\S+\s+if\s+\S+\s+else\s+", t)
        assert lexer.count_docstrings(t) == count(DOCSTRING, t, "s")
        assert lexer.count_functions(t) == count(FUNCTION, t)
        assert lexer.count_spans(t, "/**", "*/") == count(r"/\*\*.*?\*/", t, "s")


MB = 1_000_000
LONG = {
    **{f"literal {q}": q + "a" * MB + q for q in "\"'`"}, **{f"open {q}": "x = 1\n" + q + "a" * MB for q in "\"'`"}, **{f"escapes {q}": ("\\" + q) * (MB // 2) for q in "\"'`"},
    "escaped literal": '"' + "\\x" * (MB // 2) + '"', "stray apostrophes": "don't\n" * 5 + "a" * MB + "\n it's", "comments": "/*" * (MB // 2), "calls": "f(" * (MB // 2), "calls, closed": "f(" * (MB // 2) + ")", "loops": "for(" * (MB // 4),
    "no space": "x" * MB, "definitions": "def x " * (MB // 6) + ":" + " " * MB, "arrows": "const a = (" * (MB // 10), "spaces": "async " + " " * MB + "for" + " " * MB, "ternaries": "a if b " * (MB // 7), "ticks": "`" * (MB - 1),
    "docs": "'''" * (MB // 3), "certificate": 'cert = "' + "MIIC/+=" * (MB // 7) + '"', "blank lines": " \n" * (MB // 2), "fences": "```" * (MB // 3), "hashes": "# " * (MB // 2),
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_of_anything(name):
    start = time.process_time()
    for language in ("typescript", "python"):
        measures.measure("README.md", LONG[name], language)
    assert time.process_time() - start < 20


def test_counts_outside_of_long_literals():
    js = f'const s = "{"if (a) " * 100_000}"; if (a) {{ b() }} // if (c)\n'
    assert dict(zip(measures.BRANCH_WEIGHTS, measures.branch_counts(js, "js")))["if"] == 1
    python = f"s = '{'if a: ' * 100_000}'\nif a: pass\nx = 1 if y else 2\n"
    got = dict(zip(measures.BRANCH_WEIGHTS, measures.branch_counts(python, "python")))
    assert (got["if"], got["ternary"]) == (2, 1)


def test_required_literals():
    need = lambda p, f="": required(python_pattern(p, f))
    assert need(r"\beval\s*\(") == {"eval"}
    assert need(r"(?:curl|wget)\s+x") == {"curl", "wget"}
    assert need(r"https?://") == {"http://", "https://"}
    assert need(r"(?:secret)?\w+") is None and need(r"a|b") is None and need(r"[^x]+") is None
    assert need(r"(?:foo\d+)+BAR", "i") == {"foo"} or need(r"(?:foo\d+)+BAR", "i") == {"bar"}
    assert need(r"(?!abc)de") == {"de"}


def test_the_prefilter_leaves_out_nothing():
    """Every expression still runs on texts that it matches: pieces of expressions put together at random."""
    patterns = [python_pattern(*p) for p in WEB3.values()] + [d.needed for d in detectors(True) if d.needed is not None]
    pieces = sorted({s for p in patterns for s in required(p) or ()})
    rng, matched, fil = random.Random(5), 0, Prefilter(patterns)
    fillers = [" ", "(", ")", "=", '"', "'", "\n", "0x" + "a" * 40, "${", "}", ".", ":", "user", "await ", "1", "[", "]", ">", ",", "/"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces if rng.random() < 0.4 else fillers) for _ in range(rng.randrange(1, 14)))
        text = text.upper() if rng.random() < 0.1 else text
        may = fil.may_match(text)
        hits = {k for k, p in enumerate(patterns) if p.search(text)}
        matched += len(hits)
        assert hits <= may
    assert matched > 3000
    assert sum(required(p) is None for p in patterns) < 10


def test_a_failing_check_is_told_and_others_go_on():
    def broken(src):
        raise ValueError("no")

    scanner = Scanner([FileCheck("X-1", "mine", broken), FileCheck("X-2", "mine", lambda src: [])])
    from scanloom.functions.source import Source

    src = Source("a.ts", "text")
    assert [(k, h.detector) for k, h in scanner.hits(src, scanner.may_match(src))] == [(0, "SCANNER-ERR-mine")]


def test_leading_words_are_searched_as_strings():
    import re

    from scanloom.functions.dialect import python_pattern

    text = "if x: elif (if y) _if z ifs if\tz\nif  for(i) xfor (j)"
    for p in (r"\bif\s+", r"\bfor\s*\(", r"\bor\b", r"\bif\b|\belif\b"):
        got = python_pattern(p)
        assert got.pattern.startswith(p[2:4]) and [m.span() for m in got.finditer(text)] == [m.span() for m in re.finditer(p, text, re.A)]
    assert python_pattern(r"\bifs?").pattern == r"\bifs?" and python_pattern(r"\bif", "i").pattern == r"\bif"


def test_lines_and_comments_equal_their_plain_definitions():
    from scanloom.functions.dialect import SPACES
    from scanloom.functions.source import Source, trimmed

    hash_line, rng = python_pattern(r"^\s*#"), random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(["\n", "//", "/*", "*/", " ", "# ", " ", "﻿", "\x85", "x", "ab "]) for _ in range(rng.randrange(1, 60)))
        assert trimmed(text) == re.sub(rf"\A[{SPACES}]+|[{SPACES}]+\Z", "", text)
        src = Source("a.ts", text)
        for at in rng.choices(range(len(text)), k=20):
            before, start = text[max(0, at - 500) : at], text.rfind("\n", 0, at + 1) + 1
            assert src.line_number(at) == text[:at].count("\n") + 1
            assert src.in_comment(at) == ("//" in text[start:at] or bool(hash_line.match(text[start : at + 10])) or before.rfind("/*") > before.rfind("*/"))


def test_what_runs_on_a_file_is_worked_out_once_for_equal_strings():
    from scanloom.functions.source import Source

    scanner = Scanner([d for d in detectors(True) if d.rule == "storage"])
    one, other, unread = (Source(p, t) for p, t in (("a.ts", 'password = "abcdef"'), ("b.ts", 'x;\npassword = "ghijkl"'), ("c.sol", 'password = "abcdef"')))
    assert scanner.may_match(one) and scanner.may_match(one) is scanner.may_match(other)
    assert scanner.run(one, scanner.may_match(one)) is scanner.run(other, scanner.may_match(other))
    # no detector of the rule reads such files
    assert scanner.may_match(unread) == frozenset()


def test_beginnings():
    begin = lambda p, f="": beginnings(python_pattern(p, f))
    assert begin(r"\beval\s*\(") == {"eval"}
    assert begin(r"\b(?:curl|wget)\s+x|\.then\(") == {"curl", "wget", ".then("}
    assert begin(r"cross[-\s]?chain|crossing", "i") == {"cross"}
    assert begin(r"(?:foo\d+)+BAR") == {"foo"} and begin(r"(?!abc)de") == {"de"}
    assert begin(r"(?:secret)?word") == {"secretword", "word"} and begin(r"x*word") is None and begin(r"`[^`]*`") is None and begin(r"[^x]+yz") is None


def test_finders_find_what_expressions_find():
    """On pieces of expressions put together at random, and on characters that become two when lower-cased."""
    patterns = [python_pattern(*p) for p in WEB3.values()] + [d.needed for d in detectors(True) if d.needed is not None]
    finders = [Finder(p) for p in patterns]
    pieces = sorted({s for p in patterns for s in required(p) or ()} | {s for p in patterns for s in beginnings(p) or ()} | {t for ts in TEXTS.values() for t in ts})
    fillers = [" ", "(", ")", "=", '"', "\n", "0x" + "a" * 40, "${", "}", ".", ":", "user", "1", "[", "]", "/", "\u0130", "\u017f", "\u212a", "\u00e9"]
    rng, matched = random.Random(7), 0
    for _ in range(1500):
        text = "".join(rng.choice(pieces if rng.random() < 0.5 else fillers) for _ in range(rng.randrange(1, 12)))
        text = text.upper() if rng.random() < 0.1 else text
        for p, f in zip(patterns, finders):
            want = [m.span() for m in p.finditer(text)]
            assert [m.span() for m in f.finditer(text)] == want and [m.span() for m in f.finditer(text, low=text.lower())] == want
            assert bool(f.search(text)) == bool(want)
            matched += len(want)
    assert matched > 3000
    assert sum(beginnings(p) is None for p in patterns) < 20


def test_expressions_are_not_run_where_their_strings_are_missing():
    finder, tried = Finder(python_pattern(r"\b(?:bridge|cross[-\s]?chain)\b", "i")), []
    assert finder.search("prose") is None and finder.holds and finder.begins

    class Counted:
        match = lambda self, text, at: tried.append(at)

    finder.pattern = Counted()
    assert finder.search("prose " * 100) is None and list(finder.finditer("some prose. A Bridge. " * 3)) == [] and tried == [14, 36, 58]


def test_few_strings_need_no_automaton():
    few, many = Prefilter([python_pattern(r"wallet_request|\brequest\b")]), Prefilter([python_pattern(f"word{k}x") for k in range(FEW + 1)])
    assert few.of.made is None and [s for s, _ in few.of.few] == ["request"]
    assert few.may_match("a WALLET_REQUEST") and few.may_match("b Request") is few.may_match("request") and not few.may_match("c")
    assert many.may_match("a word3x word5x") == {3, 5} and many.may_match("a WORD3X", low="a word3x") == {3}
