"""Which expressions can match a text at all, and where, told by the strings that they need.

Of each expression the strings are worked out of which every match holds at
least one.  Many strings of many expressions make one Aho-Corasick automaton, a
few are looked for one by one; the strings that a text holds say which expressions
have to be run on it.  An expression whose matches all begin with certain strings
is tried at these alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from re import _constants as K
from re import _parser
from types import SimpleNamespace

try:
    import ahocorasick
except ImportError:  # the strings are then looked for one by one
    ahocorasick = None

#: Alternatives of a class or a run of characters that are written out; characters that a string has at least.
MOST, LEAST = 64, 2
#: Answers that are kept at most.
KNOWN = 4096
#: Strings that are looked for one by one at most; each costs a twentieth of a pass of the automaton.
FEW = 16


@lru_cache(maxsize=1024)
def required(pattern: re.Pattern) -> frozenset[str] | None:
    """Lower-cased strings of which every match holds one (in its text, lower-cased); None if there is no such set."""
    exact, needs = _sequence(_parser.parse(pattern.pattern, pattern.flags))
    return _best([exact, *needs])


@lru_cache(maxsize=1024)
def beginnings(pattern: re.Pattern) -> frozenset[str] | None:
    """Lower-cased strings of which one stands at the start of every match, lower-cased; None if there is no such set."""
    found = _front(_parser.parse(pattern.pattern, pattern.flags))
    return _shortest(found) if min(map(len, found)) >= LEAST else None


def _shortest(strings: frozenset[str]) -> frozenset[str]:
    """Without those that begin with another."""
    return frozenset(s for s in strings if not any(s != t and s.startswith(t) for t in strings))


def _front(items) -> frozenset[str]:
    """The strings that matches of the items begin with, as far as these are few."""
    run = frozenset([""])
    for kind, value in items:
        exact = _node(kind, value)[0]
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        if kind is K.SUBPATTERN:
            more = _front(value[-1])
        elif kind is K.BRANCH:
            more = frozenset().union(*map(_front, value[1]))
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            more = _front(value[2])
        else:
            break
        return frozenset(a + b for a in run for b in more) if len(run) * len(more) <= MOST else run
    return run


def _best(sets: list[frozenset[str] | None]) -> frozenset[str] | None:
    """The set whose shortest string is longest; of these the smallest one."""
    usable = [s for s in sets if s and min(map(len, s)) >= LEAST]
    return max(usable, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _sequence(items) -> tuple[frozenset[str] | None, list[frozenset[str]]]:
    """All strings that the items match, if these are few; and sets of which every match holds a string."""
    run, needs, whole = frozenset([""]), [], True
    for item in items:
        exact, own = _node(*item)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        needs += [run, *own] if exact is None else [run]
        run = frozenset([""]) if exact is None else exact
    return (run, []) if whole else (None, [*needs, run])


def _node(kind, value) -> tuple[frozenset[str] | None, list[frozenset[str]]]:
    if kind is K.LITERAL:
        return frozenset([chr(value).lower()]), []
    if kind is K.IN:
        return _class(value), []
    if kind in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return frozenset([""]), []
    if kind is K.SUBPATTERN:
        return _sequence(value[-1])
    if kind is K.ATOMIC_GROUP:
        return _sequence(value)
    if kind is K.BRANCH:
        found = [_sequence(x) for x in value[1]]
        if all(exact is not None for exact, _ in found) and sum(len(exact) for exact, _ in found) <= MOST:
            return frozenset().union(*(exact for exact, _ in found)), []
        best = [_best([exact, *needs]) for exact, needs in found]
        return None, [frozenset().union(*best)] if all(best) else []
    if kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, sub = value
        exact, needs = _sequence(sub)
        if low == 0:
            return (exact | {""}, []) if high == 1 and exact is not None else (None, [])
        if low == high == 1:
            return exact, needs
        return None, needs if exact is None else [exact]
    return None, []


def _class(items) -> frozenset[str] | None:
    out = set()
    for kind, value in items:
        if kind is K.LITERAL:
            out.add(chr(value).lower())
        elif kind is K.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 4 else None


@lru_cache(maxsize=32)
def _automaton(needs: tuple[frozenset[str] | None, ...]) -> SimpleNamespace:
    """The strings with the places in ``sets`` of the numbers of the sets that hold them, and the numbers of those without strings."""
    numbers: dict[str, list[int]] = {}
    for k, strings in enumerate(needs):
        # a string that holds another one of its set tells nothing more
        for s in (s for s in strings or () if not any(t != s and t in s for t in strings)):
            numbers.setdefault(s, []).append(k)
    sets = sorted({tuple(k) for k in numbers.values()})
    held = {s: sets.index(tuple(k)) for s, k in numbers.items()}
    made = None
    if ahocorasick is not None and len(held) > FEW:
        made = ahocorasick.Automaton()
        for s, k in held.items():
            made.add_word(s, k)
        made.make_automaton()
    return SimpleNamespace(few=list(held.items()), sets=sets, made=made, always=frozenset(k for k, s in enumerate(needs) if s is None))


class Prefilter:
    """Tells which of some expressions may match a text; of None, which stands for no expression, always."""

    def __init__(self, patterns: list[re.Pattern | None]):
        self.of = _automaton(tuple(required(p) if p is not None else None for p in patterns))
        self.known: dict[frozenset[int] | tuple[int, ...], frozenset[int]] = {}

    def may_match(self, text: str, low: str | None = None) -> frozenset[int]:
        """Numbers of the expressions; the same object for texts that hold the same strings.  low: as for ``Finder``."""
        low = text.lower() if low is None else low
        if self.of.made is not None:
            found = frozenset({k for _, k in self.of.made.iter(low)})
        else:
            found = tuple([k for s, k in self.of.few if s in low])
        if found not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[found] = self.of.always.union(*(self.of.sets[k] for k in found))
        return self.known[found]


class Finder:
    """An expression that is tried where its strings stand alone; it finds what the expression finds.

    low: the text lower-cased, where the caller has it.
    """

    def __init__(self, pattern: re.Pattern):
        self.pattern = pattern

    @cached_property
    def holds(self) -> list[str] | None:
        found = required(self.pattern)
        return found and [s for s in found if not any(t != s and t in s for t in found)]

    @cached_property
    def begins(self) -> list[str] | None:
        found = beginnings(self.pattern)
        return found and list(found)

    def search(self, text: str, *, low: str | None = None) -> re.Match | None:
        if self.holds:
            low = text.lower() if low is None else low
            for s in self.holds:
                if s in low:
                    break
            else:
                return None
        return self.pattern.search(text)

    def finditer(self, text: str, *, low: str | None = None) -> Iterator[re.Match]:
        if not self.begins:
            return self.pattern.finditer(text)
        low = text.lower() if low is None else low
        # where lower-casing makes characters more, places are not those of the text
        return self._tried(text, low) if len(low) == len(text) else self.pattern.finditer(text)

    def _tried(self, text: str, low: str) -> Iterator[re.Match]:
        places = []
        for s in self.begins:
            at = low.find(s)
            while at >= 0:
                places.append(at)
                at = low.find(s, at + 1)
        if len(places) > 1:
            places.sort()
        end = 0
        for at in places:
            if at >= end and (m := self.pattern.match(text, at)):
                yield m
                end = m.end()
