"""Detectors over files, as declarations.

A detector has an expression to find, predicates on what stands around a match,
and the file extensions that it reads.  An automaton over the strings that the
expressions need tells which of them can match a file at all; these are run, and
offsets, lines and comments are worked out, in one pass over a file for all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.functions.dialect import python_pattern
from scanloom.functions.literals import KNOWN, Finder, Prefilter
from scanloom.functions.source import Source
from scanloom.packaging import ready_for_python

#: Begins the id of a finding that stands for a rule that failed; its rule, and its category.
FAILED, FAILED_RULE, FAILED_CATEGORY = "SCANNER-ERR-", "scanner-internal", "skill-injection"

Predicate = Callable[[Source, re.Match], bool]

HIT_SCHEMA = "skill_id string, detector string, suffix string, severity string, title string, rel_path string, line int, evidence string, file_ord long, pattern_ord int, at long"


class Hit(NamedTuple):
    """One finding in a file; line and evidence may be missing, and suffix makes its id."""

    detector: str
    severity: str
    title: str
    at: int = 0
    line: int | None = None
    evidence: str | None = None
    suffix: str | None = None
    pattern_ord: int = 0


@dataclass(frozen=True)
class Detector:
    """Reports matches of an expression that all predicates let pass.

    once: only the first that passes; strictly_first: the first match or none.
    numbered: the id carries the running number in the rule.
    """

    id: str
    rule: str
    severity: str
    title: str
    pattern: str
    flags: str = ""
    where: tuple[Predicate, ...] = ()
    extensions: frozenset[str] = frozenset()
    once: bool = False
    strictly_first: bool = False
    numbered: bool = True
    shown: Callable[[str], str] | None = None
    suffix: Callable[[Source, re.Match], str] | None = None
    found: re.Pattern = field(init=False, compare=False)
    finder: Finder = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "found", python_pattern(self.pattern, self.flags))
        object.__setattr__(self, "finder", Finder(self.found))

    def reads(self, ext: str) -> bool:
        return ext in self.extensions

    def passing(self, src: Source) -> Iterator[re.Match]:
        """The matches that are reported."""
        for m in self.finder.finditer(src.content, low=src.low):
            for p in self.where:
                if not p(src, m):
                    break
            else:
                yield m
                if self.once:
                    return
            if self.strictly_first:
                return

    def hits(self, src: Source) -> list[Hit]:
        out, shown, suffix = [], self.shown, self.suffix
        for m in self.passing(src):
            at = m.start()
            text = src.line_text(at)
            out.append(Hit(self.id, self.severity, self.title, at, src.line_number(at), shown(text) if shown else text, suffix(src, m) if suffix else None))
        return out

    @property
    def needed(self) -> re.Pattern:
        return self.found


@dataclass(frozen=True)
class FileCheck:
    """Any other computation on a file; ``needs`` is an expression that must match for it to find anything."""

    id: str
    rule: str
    check: Callable[[Source], Iterable[Hit]]
    extensions: frozenset[str] | None = None
    needs: str | None = None
    flags: str = ""
    path: str | None = None
    numbered: bool = False

    def reads(self, ext: str) -> bool:
        return self.extensions is None or ext in self.extensions

    def hits(self, src: Source) -> Iterable[Hit]:
        return self.check(src)

    @property
    def needed(self) -> re.Pattern | None:
        return python_pattern(self.needs, self.flags) if self.needs else None


# ---- predicates


def not_comment(src: Source, m: re.Match) -> bool:
    return not src.in_comment(m.start())


def not_prose(src: Source, m: re.Match) -> bool:
    return not src.in_prose(m.start())


def window(before: int, after: int, has: str | None = None, lacks: str | None = None, flags: str = "") -> Predicate:
    """The characters around a match's start hold one expression and lack another."""
    wanted, barred = (Finder(python_pattern(p, flags)) if p else None for p in (has, lacks))

    def test(src: Source, m: re.Match) -> bool:
        text = src.around(m.start(), before, after)
        return (not wanted or bool(wanted.search(text))) and not (barred and barred.search(text))

    return test


def in_file(has: str | None = None, lacks: str | None = None, flags: str = "", lacks_flags: str = "") -> Predicate:
    wanted, barred = Finder(python_pattern(has, flags)) if has else None, Finder(python_pattern(lacks, lacks_flags)) if lacks else None
    return lambda src, m: (not wanted or src.has(wanted)) and not (barred and src.has(barred))


def on_line(has: str, flags: str = "") -> Predicate:
    wanted = python_pattern(has, flags)
    return lambda src, m: bool(wanted.search(src.line_text(m.start())))


def code_only(src: Source, m: re.Match) -> bool:
    return src.ext not in ("md", "mdx")


# ---- running them


def with_extension(files: DataFrame) -> DataFrame:
    return files.withColumn("ext", F.lower(F.substring_index("rel_path", ".", -1)))


class Scanner:
    """Runs detectors on files, those alone that can find something there.

    tests: further expressions that ``holds`` answers for, by their numbers.
    """

    def __init__(self, detectors: list[Detector | FileCheck], tests: list[re.Pattern] = ()):
        self.detectors, self.tests = detectors, list(tests)
        self.filter = Prefilter([*self.tests, *(d.needed for d in detectors)])
        self.paths = {k: re.compile(d.path.replace(r"\z", r"\Z")).search for k, d in enumerate(detectors) if isinstance(d, FileCheck) and d.path}
        self.read: dict[str, list[int]] = {}
        self.chosen: dict[tuple[str, frozenset[int]], list[int]] = {}

    def readers(self, ext: str) -> list[int]:
        """Numbers of the detectors that read files of an extension."""
        if ext not in self.read:
            if len(self.read) >= KNOWN:
                self.read.clear()
            self.read[ext] = [k for k, d in enumerate(self.detectors) if d.reads(ext)]
        return self.read[ext]

    def may_match(self, src: Source) -> frozenset[int]:
        """Numbers of the tests, then of the detectors, that can match; a file that nothing reads is not looked at."""
        return self.filter.may_match(src.content, src.low) if self.tests or self.readers(src.ext) else frozenset()

    def holds(self, test: int, src: Source, may: frozenset[int]) -> bool:
        return test in may and bool(self.tests[test].search(src.content))

    def run(self, src: Source, may: frozenset[int]) -> list[int]:
        """Numbers of the detectors to run on a file."""
        key = src.ext, may
        if key not in self.chosen:
            if len(self.chosen) >= KNOWN:
                self.chosen.clear()
            first = len(self.tests)
            self.chosen[key] = [k for k in self.readers(src.ext) if first + k in may]
        ran = self.chosen[key]
        return [k for k in ran if k not in self.paths or self.paths[k](src.path)] if self.paths else ran

    def hits(self, src: Source, may: frozenset[int]) -> Iterator[tuple[int, Hit]]:
        """Hits with the numbers of their detectors."""
        for k in self.run(src, may):
            for h in found_by(self.detectors[k], src):
                yield k, h

    def counts(self, src: Source, may: frozenset[int], suffixed: frozenset[str]) -> Iterator[tuple[str, str | None, str, int]]:
        """Hits by detector, suffix (of the detectors named) and severity: their numbers, without what a hit shows."""
        for k in self.run(src, may):
            d = self.detectors[k]
            if isinstance(d, Detector) and d.id not in suffixed:
                try:
                    n = sum(1 for _ in d.passing(src))
                except Exception:  # noqa: BLE001  found_by says what it raised
                    yield from ((h.detector, h.suffix, h.severity, 1) for h in found_by(d, src))
                    continue
                if n:
                    yield d.id, None, d.severity, n
            else:
                for h in found_by(d, src):
                    yield h.detector, h.suffix if h.detector in suffixed else None, h.severity, 1


def scan_files(files: DataFrame, detectors: list[Detector | FileCheck], distinct: bool = False) -> DataFrame:
    """Runs detectors over (skill_id, file_ord, rel_path, content); returns rows of HIT_SCHEMA.

    Files with a null path or content are not read.  Each file is handled on
    its own where it lies; nothing is shuffled and contents end here.  A check
    that raises on a file gives a hit of its own there (see found_by).  distinct:
    of a file's hits that differ in nothing but their places, the first alone.
    """
    ready_for_python(files.sparkSession)
    # nulls are passed over in tasks: a filter here would work out paths and contents twice
    read = files.select("skill_id", "file_ord", "rel_path", "content")

    def run(batches):
        scanner = Scanner(detectors)
        for batch in batches:
            files, rows = [], []
            for place, path, content in zip(range(batch.num_rows), *(strings(batch.column(c)) for c in ("rel_path", "content"))):
                if path is None or content is None:
                    continue
                src = Source(path, content)
                found = [(k, h) for k in scanner.run(src, scanner.may_match(src)) for h in found_by(scanner.detectors[k], src)]
                told = set() if distinct and len(found) > 1 else None
                for k, h in found:
                    if told is not None:
                        said = (h.detector, h.suffix, h.severity, h.title, h.evidence)
                        if said in told:
                            continue
                        told.add(said)
                    files.append(place)
                    rows.append((h.detector, h.suffix, h.severity, h.title, h.line, h.evidence, k * 100 + h.pattern_ord, h.at))
            yield _table(batch, files, rows)

    return read.mapInArrow(run, HIT_SCHEMA)


def count_hits(files: DataFrame, detectors: list[Detector | FileCheck], suffixed: frozenset[str] = frozenset(), most: int = 20_000) -> DataFrame:
    """Numbers of hits over (skill_id, rel_path, content): skill_id, detector, suffix, severity, n.

    Counted in tasks, so that no hit goes on by itself; ``most`` entries are held at
    once.  suffixed: detectors whose hits are counted by suffix too; others have null.
    """
    ready_for_python(files.sparkSession)
    read = files.select("skill_id", "rel_path", "content")
    schema = StructType([read.schema["skill_id"], *StructType.fromDDL("detector string, suffix string, severity string, n long")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        scanner, held = Scanner(detectors), Counter()

        def out():
            columns = list(zip(*((*key, n) for key, n in held.items()))) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            for skill, path, content in zip(batch.column("skill_id").to_pylist(), *(strings(batch.column(c)) for c in ("rel_path", "content"))):
                if path is None or content is None:
                    continue
                src = Source(path, content)
                for *key, n in scanner.counts(src, scanner.may_match(src), suffixed):
                    held[(skill, *key)] += n
                if len(held) > most:
                    yield out()
                    held.clear()
        yield out()

    return read.mapInArrow(run, schema).groupBy(*schema.names[:-1]).agg(F.sum("n").alias("n"))


def found_by(detector: Detector | FileCheck, src: Source) -> list[Hit]:
    """A detector's hits; of one that raises, a hit that says so, and the run goes on."""
    try:
        return list(detector.hits(src))
    except Exception as error:  # noqa: BLE001  whatever a check raises is its own
        return [Hit(f"{FAILED}{detector.rule}", "info", f"Scanner rule '{detector.rule}' threw an error", evidence=f"{detector.id}: {error}")]


def strings(column: pa.Array) -> list[str | None]:
    """A column's strings, made at once: ``to_pylist`` makes an object of Arrow's for each first."""
    return column.to_numpy(zero_copy_only=False).tolist()


_TYPES = {part.split()[0]: pa.string() if "string" in part else pa.int32() if " int" in part else pa.int64() for part in HIT_SCHEMA.split(", ")}
#: What a hit has of its file; the rest, in the order of rows.
_OF_FILE = ("skill_id", "rel_path", "file_ord")
_OF_HIT = [n for n in _TYPES if n not in _OF_FILE]


def _table(batch: pa.RecordBatch, files: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Hits, with the places in the batch of their files."""
    held = dict(zip(_OF_HIT, zip(*rows) if rows else [()] * len(_OF_HIT)))
    places = pa.array(files, pa.int32())
    own = {n: batch.column(n).take(places).cast(_TYPES[n]) for n in _OF_FILE}
    return pa.RecordBatch.from_arrays([own[n] if n in own else pa.array(held[n], t) for n, t in _TYPES.items()], names=list(_TYPES))
