"""One text file under detection: lines, comments, prose, and windows around an offset."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property

from scanloom.functions.dialect import SPACES, python_pattern
from scanloom.functions.literals import Finder

_SPACE = "".join(filter(re.compile(f"[{SPACES}]").match, map(chr, range(0x10000))))
_HASH = python_pattern(r"\s*#").match
_FENCE = re.compile(r"^[ \t]{0,3}(?:```|~~~)", re.M)


def trimmed(text: str) -> str:
    return text.strip(_SPACE)


def extension(path: str) -> str:
    """What follows the last dot, lower-cased; a name without a dot as a whole."""
    return path.rsplit(".", 1)[-1].lower()


class Source:
    """Answers that detectors share; offsets are characters.  Files may be small and many: nothing is made before it is asked for."""

    _counted = 0, 1

    def __init__(self, path: str, content: str, ext: str | None = None):
        self.path, self.content, self.ext = path, content, extension(path) if ext is None else ext

    @cached_property
    def low(self) -> str:
        return self.content.lower()

    @cached_property
    def _held(self) -> dict[Finder, bool]:
        return {}

    def has(self, finder: Finder) -> bool:
        """Whether an expression matches anywhere; looked for once."""
        if finder not in self._held:
            self._held[finder] = bool(finder.search(self.content, low=self.low))
        return self._held[finder]

    @cached_property
    def starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.content))]

    @cached_property
    def lines(self) -> list[str]:
        return self.content.split("\n")

    @cached_property
    def fences(self) -> list[int]:
        return [m.start() for m in _FENCE.finditer(self.content)]

    def line_number(self, at: int) -> int:
        """Counted on from the offset asked for before; offsets that go back are looked up."""
        last, line = self._counted
        if at < last:
            return bisect_right(self.starts, at)
        line += self.content.count("\n", last, at)
        self._counted = at, line
        return line

    def line_start(self, at: int) -> int:
        """Where the line begins; an offset on a line break begins with the next line."""
        return self.content.rfind("\n", 0, at + 1) + 1

    def line_text(self, at: int) -> str:
        start, end = self.line_start(at), self.content.find("\n", at)
        return trimmed(self.content[start : end if end >= 0 else None])

    def in_comment(self, at: int) -> bool:
        """After ``//`` on its line, on a ``#`` line, or in a block comment begun in the 500 characters before."""
        text, start, before = self.content, self.line_start(at), max(0, at - 500)
        return text.find("//", start, at) >= 0 or _HASH(text, start, at + 10) is not None or text.rfind("/*", before, at) > text.rfind("*/", before, at)

    def in_prose(self, at: int) -> bool:
        """In a Markdown file, outside fenced code."""
        return self.ext in ("md", "mdx") and bisect_right(self.fences, at) % 2 == 0

    def around(self, at: int, before: int, after: int) -> str:
        return self.content[max(0, at - before) : at + after]
