"""Expressions in the dialect of the detectors, for Python and for the JVM.

In that dialect word characters and digits are ASCII, ``\\s`` has all Unicode
spaces and the byte-order mark, and ``$`` is only the very end.
"""

from __future__ import annotations

import re
from functools import lru_cache

# What \s stands for.
SPACES = r"\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_FLAGS = {"i": re.I, "s": re.S, "m": re.M}
_TOKEN = re.compile(r"\\.|\[\^?|\]|\$|.", re.S)


def _translate(pattern: str, spaces: str, end: str, bracket: str) -> str:
    """Rewrites spaces and ends, minding classes."""
    out, inside = [], False
    for t in _TOKEN.findall(pattern):
        if t in (r"\s", r"\S"):
            negated = t == r"\S"
            if inside:
                out.append(spaces if not negated else t)
            else:
                out.append(f"[{'^' if negated else ''}{spaces}]")
            continue
        if t[0] == "[" and not inside:
            inside = True
        elif t == "]" and inside:
            inside = False
        elif t[0] == "[":
            t = bracket + t
        elif t == "$" and not inside:
            t = end
        out.append(t)
    return "".join(out)


#: A word at the front, behind a border.
_FRONT = re.compile(r"\\b([A-Za-z_]{2,})(?![A-Za-z_?*+{])")


@lru_cache(maxsize=1024)
def python_pattern(pattern: str, flags: str = "") -> re.Pattern:
    """The expression for Python.

    A word that it begins with stands before its border's test: the word is then
    searched for as a string, where a border would be tested at each character.
    """
    end = "$" if "m" in flags else r"\Z"
    if "i" not in flags and (m := _FRONT.match(pattern)):
        pattern = f"{m[1]}(?<=\\b{m[1]}){pattern[m.end() :]}"
    return re.compile(_translate(pattern, SPACES, end, "\\"), re.A | sum(_FLAGS[f] for f in flags))


_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_BORDER = rf"(?:(?<=[A-Za-z0-9_]){_AFTER}|{_BEFORE}(?=[A-Za-z0-9_]))"


def _alternatives(tokens: list[str], at: int, step: int) -> list[list[str]]:
    """What can stand next to a border, going on from ``at``: of a group each of its alternatives."""
    opens, closes = ("(", ")") if step > 0 else (")", "(")
    if not 0 <= at < len(tokens):
        return [[]]
    if tokens[at] != opens:
        return [tokens[at::step]]
    depth, out, own = 0, [], []
    for t in tokens[at::step]:
        depth += (t == opens) - (t == closes)
        if depth == 0:
            return [*out, own]
        if depth == 1 and t == "|":
            out.append(own)
            own = []
        elif not (depth == 1 and t == opens):
            own.append(t)
    return [[]]


def _on_word(tokens: list[str], at: int, step: int) -> bool:
    """Whether only word characters can stand next to a border there."""
    for own in _alternatives(tokens, at, step):
        if step > 0 and own[:2] == ["?", ":"]:
            own = own[2:]
        if step < 0 and own[-2:] == [":", "?"]:
            own = own[:-2]
        if step < 0 and own[-1:] == ["?"]:
            return False  # a look, which takes no characters
        if not own or not (re.fullmatch(r"\w", own[0], re.A) or own[0] in (r"\w", r"\d")) or (step > 0 and own[1:2] and own[1] in "?*{"):
            return False
    return True


def _borders(pattern: str) -> str:
    """Word borders of ASCII words: of one look where the pattern says on which side the word is."""
    # classes count as one token, which is no word
    tokens = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|.", pattern, re.S)
    out = []
    for i, t in enumerate(tokens):
        if t == r"\b":
            t = _BEFORE if _on_word(tokens, i + 1, 1) else _AFTER if _on_word(tokens, i - 1, -1) else _BORDER
        out.append(t)
    return "".join(out)


@lru_cache(maxsize=1024)
def jvm_exact(pattern: str, flags: str = "") -> str:
    """The expression for the JVM, with borders of ASCII words."""
    text = _translate(_borders(pattern), SPACES.replace(r"\v", r"\x0B"), r"\z" if "m" not in flags else "$", "\\")
    own = "".join(f for f in flags if f in "ism")
    return f"(?{own}){text}" if own else text
