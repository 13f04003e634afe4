"""Source text without comments and strings, and counts over it, in linear time.

Texts may be a single line of a megabyte, may leave quotes, comments and
parentheses open, and may hold literals of any length.  Every function looks at
each character a bounded number of times and keeps no stack; what an expression
would look for again from each start (the next closing character) is looked for
once.  Results are those of the expressions that the docstrings give.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

from scanloom.functions.dialect import SPACES, python_pattern

#: White space of the dialect, for str.strip.
BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORDS = re.compile(f"[^{SPACES}]+")


class Next:
    """The next place of a string at or after a position, for positions that do not go back."""

    def __init__(self, text: str, wanted: str):
        self.text, self.wanted, self.at = text, wanted, -1

    def after(self, start: int) -> int:
        """Its place, or the text's length where it does not come again."""
        if self.at < start:
            found = self.text.find(self.wanted, start)
            self.at = len(self.text) if found < 0 else found
        return self.at


def without_spans(text: str, opening: str, closing: str, put: str) -> str:
    """What ``opening.*?closing`` finds is replaced."""
    out, done = [], 0
    while (start := text.find(opening, done)) >= 0 and (end := text.find(closing, start + len(opening))) >= 0:
        out += (text[done:start], put)
        done = end + len(closing)
    return "".join([*out, text[done:]]) if out else text


@lru_cache(maxsize=8)
def _body(quote: str) -> Callable[[str, int], re.Match]:
    """From after a quote on, everything up to what ends the literal: its quote, a backslash before a line's end, or the text's end."""
    return re.compile(rf"[^{quote}\\]*+(?:\\[^\n\r\u2028\u2029][^{quote}\\]*+)*+").match


def without_quoted(text: str, quote: str) -> str:
    """What ``"(?:[^"\\\\]|\\\\.)*"`` finds becomes an empty literal.

    Where no literal ends, all quotes up to there stand behind backslashes, and
    none of them begins a literal either; so the search goes on after that place.
    """
    body, out, done, start = _body(quote), [], 0, text.find(quote)
    while start >= 0:
        end = body(text, start + 1).end()
        if text[end : end + 1] == quote:
            out += (text[done:start], quote, quote)
            done = end + 1
        start = text.find(quote, end + 1)
    return "".join([*out, text[done:]]) if out else text


def stripped(text: str, kind: str) -> str:
    """Source text without comments, its literals empty; in the order in which the expressions replace."""
    if kind == "js":
        text = without_spans(text, "/*", "*/", "")
        text = re.sub(r"//[^\n]*", "", text)
        return without_quoted(without_quoted(without_quoted(text, "`").replace("``", '""'), '"'), "'")
    text = without_spans(text, '"""', '"""', '""')
    text = without_spans(text, "'''", "'''", "''")
    text = re.sub(r"#[^\n]*", "", text)
    return without_quoted(without_quoted(text, '"'), "'")


def count_heads(text: str, word: str) -> int:
    r"""Matches of ``\bfor\s*\([^)]*\b<word>\b``: up to the last such word before the next closing parenthesis."""
    words = [m.start() for m in python_pattern(rf"\b{word}\b").finditer(text)]
    if not words:
        return 0
    closing, count, done = Next(text, ")"), 0, 0
    for m in python_pattern(r"\bfor\s*\(").finditer(text):
        if m.start() < done:
            continue
        last = bisect_left(words, closing.after(m.end()) - len(word) + 1) - 1
        if last >= 0 and words[last] >= m.end():
            count, done = count + 1, words[last] + len(word)
    return count


def count_ternaries(text: str) -> int:
    r"""Matches of ``\S+\s+if\s+\S+\s+else\s+``: four words in a row, the second ``if``, the fourth ``else`` and not the text's end."""
    words = _WORDS.findall(text)
    if words and text[-1:] not in BLANK:
        words.pop()  # nothing blank follows the last word
        words.append("")
    count, k = 0, 0
    while True:
        try:
            k = words.index("if", k + 1)
        except ValueError:
            return count
        if words[k + 2 : k + 3] == ["else"]:
            count, k = count + 1, k + 3


def count_spans(text: str, opening: str, closing: str) -> int:
    """Matches of ``opening.*?closing``."""
    count, done = 0, 0
    while (start := text.find(opening, done)) >= 0 and (end := text.find(closing, start + len(opening))) >= 0:
        count, done = count + 1, end + len(closing)
    return count


def count_docstrings(text: str) -> int:
    r"""Matches of ``(?:def|class)\s+\w+[^:]*:\s*\n\s*(?:\"\"\".*?\"\"\"|'''.*?''')``."""
    colon, count, done = Next(text, ":"), 0, 0
    ends: dict[int, int] = {}
    closing = {q: Next(text, q) for q in ('"""', "'''")}
    opens = re.compile(rf":[{SPACES}]*+(\"\"\"|''')").match
    for m in python_pattern(r"(?:def|class)\s+\w").finditer(text):
        if m.start() < done:
            continue
        at = colon.after(m.end())
        if at not in ends:
            found = opens(text, at)
            ends[at] = -1
            if found and "\n" in text[at : found.start(1)]:
                end = closing[found[1]].after(found.end())
                ends[at] = end + 3 if end < len(text) else -1
        if ends[at] >= 0:
            count, done = count + 1, ends[at]
    return count


# How a function begins, up to its parenthesis where it has one.  No run of spaces is taken apart again.
_HEAD = r"\b(?:(?P<word>function|class)|const\s++\w++\s*+=\s*+(?:async\s++)?(?:(?P<arrow>\()|[a-zA-Z_]\w*+\s*+=>)|(?:async\s++)?(?:get|set|static)?\s*+[a-zA-Z_]\w*+\s*+(?P<body>\())"


def count_functions(text: str) -> int:
    r"""Matches of ``\b(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>|(?:async\s+)?(?:get|set|static)?\s*(?:[a-zA-Z_]\w*)\s*\([^)]*\)\s*[:{])``."""
    head, closing, count, at = python_pattern(_HEAD).search, Next(text, ")"), 0, 0
    arrow, body = python_pattern(r"\s*=>").match, python_pattern(r"\s*[:{]").match
    known: dict[tuple[str, int], int] = {}
    while m := head(text, at):
        kind = m.lastgroup
        if kind in ("arrow", "body"):
            close = closing.after(m.end())
            if (kind, close) not in known:
                tail = (arrow if kind == "arrow" else body)(text, close + 1) if close < len(text) else None
                known[kind, close] = tail.end() if tail else -1
            if (end := known[kind, close]) < 0:
                at = m.start() + 1
                continue
        else:
            end = m.end()
        count, at = count + 1, end
    return count


def line_counts(text: str, kind: str) -> tuple[int, int, int]:
    """Lines of code, of comments, and all that are not blank; block comments are followed from line to line."""
    lines = [s for line in text.split("\n") if (s := line.strip(BLANK))]
    if kind == "python":
        comments = sum(s.startswith("#") for s in lines)
        return len(lines) - comments, comments, len(lines)
    comments, inside = 0, False
    for s in lines:
        opened = inside or s.startswith("/*")
        comments += opened or s.startswith("//")
        inside = opened and "*/" not in s
    return len(lines) - comments, comments, len(lines)
