"""Skill packages as a data source of Spark.

    register_packages(spark)
    spark.read.format("skill_packages").load("/data/skills")
    files.write.format("skill_packages").mode("append").save("/data/skills")

A root is read in partitions that each list its skills' names and take their own
share by a hash of the name, so the driver lists nothing and one root is many
tasks.  Only columns of the schema that is asked for are made: without
``content`` no file is opened but ignore files.  Filters on skill, path, language
and size are applied before a file is opened.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import LongType, StringType, StructField, StructType

from scanloom.functions.dims import LANGUAGES
from scanloom.functions.source import extension
from scanloom.packaging import BATCH_BYTES, BATCH_ROWS, ready_for_python
from scanloom.sources.files import MAX_BYTES, NUL_CHARACTERS, _below, _bytes, _opened, _qualified, _text, _walked, ignore_rules, is_ignored

COLUMNS = ("skill", "rel_path", "language", "size", "content")
PACKAGE_FILES = StructType([StructField(c, LongType() if c == "size" else StringType()) for c in COLUMNS])
#: Partitions of a root, where the option ``partitions`` says nothing.
PARTITIONS = 64

_TESTS: dict[type, Callable] = {
    EqualTo: lambda value, wanted: value == wanted, In: lambda value, wanted: value in wanted, StringStartsWith: lambda value, wanted: value.startswith(wanted),
    StringEndsWith: lambda value, wanted: value.endswith(wanted), LessThan: lambda value, wanted: value < wanted, LessThanOrEqual: lambda value, wanted: value <= wanted,
    GreaterThan: lambda value, wanted: value > wanted, GreaterThanOrEqual: lambda value, wanted: value >= wanted,
}


@dataclass
class Share(InputPartition):
    """The skills of a root whose names fall into one of so many shares."""

    root: str
    number: int
    of: int


def _uri(path: str) -> str:
    return path.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else f"file://{path.rstrip('/')}"


class PackageReader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], partitions: int, ignore: bool):
        unknown = sorted(set(columns) - set(COLUMNS))
        if unknown:
            raise ValueError(f"skill packages have no column {', '.join(unknown)}")
        self.root, self.columns, self.parts, self.ignore = _uri(root), columns, partitions, ignore
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in COLUMNS[:-1]:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        return [Share(self.root, k, self.parts) for k in range(self.parts)]

    def _wanted(self, row: dict) -> bool:
        return all(row[column] is not None and _TESTS[kind](row[column], value) for column, kind, value in self.tests if column in row)

    def _skills(self, share: Share) -> Iterator[str]:
        """Names of the share's skills; those of a scope with the scope's name before."""
        mine = lambda name: zlib.crc32(name.encode()) % share.of == share.number and self._wanted({"skill": name})
        for name, is_folder, _ in _below(share.root):
            if is_folder and name.startswith("@"):
                yield from (f"{name}/{inner}" for inner, folder, _ in _below(f"{share.root}/{name}") if folder and not inner.startswith(".") and mine(f"{name}/{inner}"))
            elif is_folder and not name.startswith(".") and mine(name):
                yield name

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for skill in self._skills(share):
            listed = [(path, size) for path, size in _walked(f"{share.root}/{skill}") if 0 < size <= MAX_BYTES]
            rules = ignore_rules(_text(_bytes(f"{share.root}/{skill}/.gitignore"))) if self.ignore and any(path == ".gitignore" for path, _ in listed) else []
            for path, size in listed:
                row = {"skill": skill, "rel_path": path, "language": LANGUAGES.get(extension(path), "unknown"), "size": size}
                if not self._wanted(row) or (rules and path != ".gitignore" and is_ignored(path, rules)):
                    continue
                if "content" in self.columns:
                    raw = _bytes(f"{share.root}/{skill}/{path}")
                    row["content"], held = (None if b"\0" in raw[:NUL_CHARACTERS] else _text(raw)), held + len(raw)
                rows.append(row)
                if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c == "size" else pa.string()) for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    """Paths that a task has written."""

    paths: list[str]


class PackageWriter(DataSourceArrowWriter):
    """Writes each row's content to skill/rel_path below the root; a task that runs again writes the same files again."""

    def __init__(self, root: str):
        self.root = _uri(root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        paths = []
        for batch in batches:
            for skill, path, content in zip(*(batch.column(c).to_pylist() for c in ("skill", "rel_path", "content"))):
                if skill is None or path is None or content is None:
                    continue
                if ".." in f"{skill}/{path}".split("/") or path.startswith("/") or skill.startswith("/"):
                    raise ValueError(f"a path that leaves its skill: {skill}/{path}")
                fs, at = _opened(f"{self.root}/{skill}/{path}")
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(content.encode())
                paths.append(at)
        return Written(paths)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what tasks that ended had written."""
        fs, _ = _opened(self.root)
        for message in messages:
            for path in message.paths if message else ():
                fs.delete_file(path)


class SkillPackages(DataSource):
    """Options: path, partitions (of a root), ignore (false: ignore files are not heeded).

    A file of more than a megabyte or of none is left out, as are folders on the
    skip list; one with a NUL at its beginning has a null content.
    """

    @classmethod
    def name(cls) -> str:
        return "skill_packages"

    def schema(self) -> StructType:
        return PACKAGE_FILES

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(self.options["path"], schema.names, int(self.options.get("partitions", PARTITIONS)), self.options.get("ignore", "true") != "false")

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        if overwrite:
            raise ValueError("packages are only added to; write to a new folder")
        missing = sorted({"skill", "rel_path", "content"} - set(schema.names))
        if missing:
            raise ValueError(f"the rows lack {', '.join(missing)}")
        return PackageWriter(self.options["path"])


def register_packages(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    ready_for_python(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SkillPackages)


def packages(spark: SparkSession, root: str, columns: tuple[str, ...] = COLUMNS, partitions: int = PARTITIONS) -> DataFrame:
    """The files of the skills below a root; of the columns named alone."""
    register_packages(spark)
    schema = StructType([PACKAGE_FILES[c] for c in columns])
    return spark.read.format("skill_packages").schema(schema).option("partitions", partitions).load(_qualified(spark, root))
