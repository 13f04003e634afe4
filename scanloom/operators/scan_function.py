"""The scanner as a table function of SQL.

    SELECT * FROM scan_files(TABLE(SELECT skill_id, file_ord, rel_path, content FROM files), 'storage')

gives the rows of ``scan_files``: one for each hit of the rules named (all, if
none is).  Rows are scanned where they lie; with PARTITION BY (skill_id) the rows of
a skill come to one task, one after the other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scanloom.functions.source import Source
from scanloom.operators.detectors import HIT_SCHEMA, Scanner
from scanloom.operators.findings import detectors, rule_names
from scanloom.packaging import ready_for_python

_KINDS = {"string": StringType(), "int": IntegerType(), "long": LongType()}
#: HIT_SCHEMA as a type; there is no session where calls are analysed.
HITS = StructType([StructField(name, _KINDS[kind]) for name, kind in map(str.split, HIT_SCHEMA.split(", "))])
COLUMNS = ("skill_id", "file_ord", "rel_path", "content")


def chosen_rules(text: str | None) -> list[str]:
    """Names of rules from a list with commas; an unknown name is an error, when the query is analysed."""
    names = [n.strip() for n in (text or "").split(",") if n.strip()]
    unknown = sorted(set(names) - set(rule_names()))
    if unknown:
        raise ValueError(f"no such rule: {', '.join(unknown)}")
    return names or rule_names()


class ScanFunction:
    """Called by SQL for each row of the table that it is given."""

    @staticmethod
    def analyze(files: AnalyzeArgument, rules: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("the first argument is a table: scan_files(TABLE(...))")
        missing = [c for c in COLUMNS if c not in files.dataType.fieldNames()]
        if missing:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        chosen_rules(rules.value if rules is not None else None)
        return AnalyzeResult(schema=HITS)

    def __init__(self):
        self.scanner: Scanner | None = None

    def eval(self, row, rules: str | None = None):
        if self.scanner is None:
            names = set(chosen_rules(rules))
            self.scanner = Scanner([d for d in detectors(True) if d.rule in names])
        if row["content"] is None or row["rel_path"] is None:
            return
        src = Source(row["rel_path"], row["content"])
        for k, h in self.scanner.hits(src, self.scanner.may_match(src)):
            yield row["skill_id"], h.detector, h.suffix, h.severity, h.title, src.path, h.line, h.evidence, row["file_ord"], k * 100 + h.pattern_ord, h.at


def register_scan_function(spark: SparkSession, name: str = "scan_files") -> None:
    """Makes the function known to the session's SQL."""
    ready_for_python(spark)
    spark.udtf.register(name, udtf(ScanFunction))
