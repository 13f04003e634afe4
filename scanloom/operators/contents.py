"""One pass over the contents of files.

Each file goes to Python once.  An automaton over the strings that the
expressions need tells which of them can match there; those are run, and the
text is measured.  What goes on is a row a file without its content: hits, the
names of the tests that hold, and counts.  Whatever fails on a file fails there
and nowhere else.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.functions.dialect import python_pattern
from scanloom.functions.dims import SECRET_IGNORES
from scanloom.functions.source import Source
from scanloom.functions.web3_patterns import WEB3
from scanloom.operators import base_rules
from scanloom.operators.detectors import Detector, FileCheck, Scanner, strings
from scanloom.operators.measures import JS_DOC_TYPES, MEASURES, PARTS, PYTHON_TYPES, measure
from scanloom.packaging import ready_for_python

#: Tests of contents by name, with their expressions and flags.
MARKS: dict[str, tuple[str, str]] = WEB3 | {
    "LOGGING": (base_rules.LOGGING, "i"), "ERROR_LOGGING": (base_rules.ERROR_LOGGING, "i"), "LOG_LIBRARY": (base_rules.LOG_LIBRARY, ""),
    "JS_DOC_TYPES": (JS_DOC_TYPES, ""), "PYTHON_TYPES": (PYTHON_TYPES, ""),
}
#: The tests that facts, metrics and web3 detection ask for.
ASKED = [
    "RPC_TOOL_RE", "VERY_SPECIFIC_PROTOCOL_RE", "WEAK_PROTOCOL_RE", "ONCHAIN_LANG_RE", "ADDRESS_RE", "WEB3_LIB_IMPORT_RE", "SEND_TX_RE", "SIGN_TX_RE", "PERSONAL_SIGN_RE", "SIGN_TYPED_DATA_RE",
    "SEND_RAW_TX_RE", "REQUEST_PERMISSIONS_RE", "AUTONOMY_TOKEN_RE", "PERMIT_MENTION_RE", "PROTECTED_RPC_REFERENCE_RE", "DANGER_WARNING_RE", "MCP_PROSE_RE", "CHAIN_PROSE_RE",
    "LOGGING", "ERROR_LOGGING", "LOG_LIBRARY", "JS_DOC_TYPES", "PYTHON_TYPES",
]
HIT = "detector: string, suffix: string, severity: string, title: string, line: int, evidence: string, pattern_ord: int, at: bigint"
_READ = f"file_ord long, rel_path string, marks array<string>, ignores_missing string, measured struct<{MEASURES}>, hits array<struct<{HIT}>>"


def read_contents(files: DataFrame, detectors: list[Detector | FileCheck] = (), asked: list[str] | None = None, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """A row per file: skill_id, file_ord, rel_path, marks, ignores_missing, measured, hits; see the module.

    files (skill_id, rel_path, content, and file_ord, language if there).  A null
    content counts as empty and has no hits; neither has a null path.  asked, parts:
    the tests and the measures that the caller needs, where these are not all.
    """
    ready_for_python(files.sparkSession)
    own = [c if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("file_ord", "long"), ("language", "string"))]
    given = files.select("skill_id", own[0], "rel_path", "content", own[1])
    schema = StructType([given.schema["skill_id"], *StructType.fromDDL(_READ)])
    tests, chosen = {n: MARKS[n] for n in (ASKED if asked is None else asked)}, list(detectors)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        scanner = Scanner(chosen, [python_pattern(*t) for t in tests.values()])
        for batch in batches:
            rows = []
            for at, path, content, language in zip(batch.column("file_ord").to_pylist(), *(strings(batch.column(c)) for c in ("rel_path", "content", "language"))):
                src = Source(path or "", content or "")
                may = scanner.may_match(src)
                marks = [n for k, n in enumerate(tests) if scanner.holds(k, src, may)]
                missing = ", ".join(x for x in SECRET_IGNORES if x not in src.content) if path == ".gitignore" else None
                hits = [(h.detector, h.suffix, h.severity, h.title, h.line, h.evidence, k * 100 + h.pattern_ord, h.at) for k, h in scanner.hits(src, may)] if path is not None and content is not None else []
                rows.append((at, path, marks, missing, tuple(measure(path, src.content, language, parts)), hits))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("skill_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

    return given.mapInArrow(run, schema)


def passed(files: DataFrame, asked: list[str] | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """Files that were read by ``read_contents`` as they are, others after that."""
    return files if "marks" in files.columns else read_contents(files, (), asked, parts)


def marked(name: str) -> Column:
    """Whether a test holds for a file that was read."""
    assert name in ASKED, name
    return F.array_contains("marks", name)


def hits_of(read: DataFrame) -> DataFrame:
    """The hits of files that were read, one row each."""
    rows = read.select("skill_id", "rel_path", "file_ord", F.explode("hits").alias("h"))
    return rows.select("skill_id", "h.detector", "h.suffix", "h.severity", "h.title", "rel_path", "h.line", "h.evidence", "file_ord", "h.pattern_ord", "h.at")
