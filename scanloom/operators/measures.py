"""What one file's text is measured by: branches, lines, documentation, licenses."""

from __future__ import annotations

import json
from typing import NamedTuple

from scanloom.functions import lexer
from scanloom.functions.dialect import python_pattern

# Branch kinds with weights; expressions by language, and what is subtracted.
BRANCH_WEIGHTS = {
    "if": 1.0, "else": 1.0, "else if": 1.0, "elif": 1.0, "switch": 1.0, "case": 0.5, "for": 2.0, "while": 2.0, "do-while": 2.0, "catch": 1.0, "ternary": 0.5,
    "logical-and": 0.3, "logical-or": 0.3, "nullish-coalesce": 0.2, "optional-chain": 0.1, "try": 0.5, "finally": 0.5, "for-in": 1.5, "for-of": 1.5,
}
JS_BRANCHES = {
    "if": r"\bif\s*\(", "else if": r"\belse\s+if\s*\(", "else": r"\belse\s*\{", "switch": r"\bswitch\s*\(", "case": r"\bcase\s+", "for": r"\bfor\s*\(",
    "for-in": r"\bfor\s*\([^)]*\bin\b", "for-of": r"\bfor\s*\([^)]*\bof\b", "while": r"\bwhile\s*\(", "do-while": r"\bdo\s*\{", "try": r"\btry\s*\{",
    "catch": r"\bcatch\s*[\({]", "finally": r"\bfinally\s*\{", "ternary": r"[^?]\?[^?.?]", "logical-and": r"&&", "logical-or": r"\|\|",
    "nullish-coalesce": r"\?\?", "optional-chain": r"\?\.",
}
JS_LESS = {"if": ["else if"], "for": ["for-in", "for-of"], "while": ["do-while"]}
PYTHON_BRANCHES = {
    "if": r"\bif\s+", "elif": r"\belif\s+", "else": r"\belse\s*:", "for": r"\bfor\s+\w+\s+in\b", "while": r"\bwhile\s+", "try": r"\btry\s*:",
    "catch": r"\bexcept\s*", "finally": r"\bfinally\s*:", "ternary": r"\S+\s+if\s+\S+\s+else\s+", "logical-and": r"\band\b", "logical-or": r"\bor\b",
}
JS_STRIPS = [(r"(?s)/\*.*?\*/", ""), (r"//[^\n]*", ""), (r"`(?:[^`\\]|\\.)*`", '""'), (r'"(?:[^"\\]|\\.)*"', '""'), (r"'(?:[^'\\]|\\.)*'", "''")]
PYTHON_STRIPS = [(r'(?s)""".*?"""', '""'), (r"(?s)'''.*?'''", "''"), (r"#[^\n]*", ""), (r'"(?:[^"\\]|\\.)*"', '""'), (r"'(?:[^'\\]|\\.)*'", "''")]
JSDOC = r"(?s)/\*\*.*?\*/"
JS_FUNCTION = r"\b(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>|(?:async\s+)?(?:get|set|static)?\s*(?:[a-zA-Z_]\w*)\s*\([^)]*\)\s*[:{])"
DOCSTRING = r'''(?s)(?:def|class)\s+\w+[^:]*:\s*\n\s*(?:""".*?"""|\'\'\'.*?\'\'\')'''
PYTHON_FUNCTION = r"\b(?:def|class)\s+"

# Licenses by their text, and names of license files; types in comments and annotations; sizes of read-me files.
LICENSES = [
    (r"MIT\s+License", "MIT"), (r"Apache\s+License.*2\.0", "Apache-2.0"), (r"GNU\s+General\s+Public\s+License", "GPL"), (r"BSD\s+[23]-Clause", "BSD"),
    (r"ISC\s+License", "ISC"), (r"Mozilla\s+Public\s+License", "MPL"), (r"The\s+Unlicense", "Unlicense"), (r"Creative\s+Commons", "CC"),
]
LICENSE_NAMES = ["license", "license.md", "license.txt", "licence", "licence.md", "licence.txt", "copying", "copying.md"]
JS_DOC_TYPES = r"@type\s*\{|@param\s*\{|@returns?\s*\{"
PYTHON_TYPES = r":\s*(?:str|int|float|bool|list|dict|tuple|Optional|Union|List|Dict)"
README_SHORT, README_GOOD = 100, 1000
README_USE = r"install|usage|getting\s+started|quick\s*start"

_JS, _PYTHON = ("javascript", "typescript", "js", "ts", "jsx", "tsx"), ("python", "py")


class Measures(NamedTuple):
    """Of one file; branches in the order of BRANCH_WEIGHTS."""

    kind: str
    branches: list[int]
    code: int
    comments: int
    lines: int
    docstrings: int
    functions: int
    readme_score: float
    license_type: str | None
    package_license: str | None
    lint_script: bool


MEASURES = "kind: string, branches: array<int>, code: int, comments: int, lines: int, docstrings: int, functions: int, readme_score: double, license_type: string, package_license: string, lint_script: boolean"


def language_kind(language: str | None) -> str:
    language = (language or "").lower()
    return "js" if language in _JS else "python" if language in _PYTHON else "unknown"


def branch_counts(text: str, kind: str) -> list[int]:
    """Branches of each kind, outside of strings and comments."""
    table, less = (JS_BRANCHES, JS_LESS) if kind == "js" else (PYTHON_BRANCHES, {})
    text = lexer.stripped(text, kind)
    # these expressions would look for the same things again from every start
    linear = {"for-in": lambda: lexer.count_heads(text, "in"), "for-of": lambda: lexer.count_heads(text, "of")} if kind == "js" else {"ternary": lambda: lexer.count_ternaries(text)}
    raw = {k: linear[k]() if k in linear else len(python_pattern(p).findall(text)) for k, p in table.items()}
    return [max(0, raw[k] - sum(raw[o] for o in less.get(k, ()))) if k in raw else 0 for k in BRANCH_WEIGHTS]


def readme_score(text: str) -> float:
    """Between 0 and 1, by length, headings, code and what it tells to do."""
    if len(text) < README_SHORT:
        return 0.2
    headings = len(python_pattern(r"^#{1,3}\s+", "m").findall(text))
    score = 0.2 + 0.5 * min(1.0, len(text) / README_GOOD) + (0.1 if headings >= 3 else 0.05 if headings else 0.0)
    score += 0.1 if lexer.count_spans(text, "```", "```") else 0.0
    return min(1.0, score + (0.1 if python_pattern(README_USE, "i").search(text) else 0.0))


def package_facts(text: str) -> tuple[str | None, bool]:
    """License and whether a script of package.json lints; what is no JSON object has neither."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None, False
    found = found if isinstance(found, dict) else {}
    named, scripts = found.get("license"), found.get("scripts")
    scripts = scripts if isinstance(scripts, dict) else {}
    return named if named is None or isinstance(named, str) else json.dumps(named, separators=(",", ":")), any(scripts.get(k) is not None for k in ("lint", "eslint"))


#: What can be measured; each is a pass over the text of its own.
PARTS = ("branches", "lines", "documentation", "texts")


def measure(path: str | None, text: str, language: str | None, parts: tuple[str, ...] = PARTS) -> Measures:
    """The parts asked for, zeros in the place of others; a null path names no file of a kind of its own."""
    kind, path = language_kind(language), path or ""
    code, comments, lines = lexer.line_counts(text, kind) if "lines" in parts else (0, 0, 0)
    if "documentation" not in parts:
        docstrings = functions = 0
    elif kind == "js":
        docstrings, functions = lexer.count_spans(text, "/**", "*/"), lexer.count_functions(text)
    elif kind == "python":
        docstrings, functions = lexer.count_docstrings(text), len(python_pattern(PYTHON_FUNCTION).findall(text))
    else:
        docstrings = functions = 0
    name = path.lower() if "texts" in parts else ""
    named = next((n for p, n in LICENSES if python_pattern(p, "i").search(text)), None) if name in LICENSE_NAMES else None
    package, lints = package_facts(text) if name == path == "package.json" else (None, False)
    return Measures(
        kind, branch_counts(text, kind) if kind != "unknown" and "branches" in parts else [0] * len(BRANCH_WEIGHTS), code, comments, lines, docstrings, functions,
        readme_score(text) if name in ("readme.md", "readme", "skill.md") else 0.0, named, package, lints,
    )
