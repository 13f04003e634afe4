"""An audit that goes on: files arrive, change and go, and each skill's totals follow.

The state of a skill is what each of its files adds, under the file's path, and
the sum of that.  A batch changes the sum by the files in it, however many files
the skill has; it is kept in Spark's state store, so a restarted stream goes on
where it stopped.  The totals are those of ``skill_totals`` over the newest
version of each file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scanloom.functions import dims
from scanloom.operators.base_rules import file_detectors
from scanloom.operators.contents import marked, read_contents
from scanloom.operators.detectors import Detector, FileCheck
from scanloom.operators.scoring import clamp

SEVERITIES = [name for name, *_ in dims.SEVERITIES]
#: What a file adds: one for itself, its hits by severity, and one for each thing that it has.
ADDED = ["files", *SEVERITIES, "code_files", "logging_files", "error_logging_files", "lockfiles", "ignore_files"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NUMBERS = ", ".join(f"{c} long" for c in ADDED)


def file_rows(files: DataFrame, detectors: list[Detector | FileCheck] | None = None) -> DataFrame:
    """(skill_id, rel_path, version, ADDED) of each row of a table or stream of files; a null content is a file that is gone.

    version: the row's file_ord.  Rows without skill, path or version are left out.
    """
    named = files.filter("skill_id IS NOT NULL AND rel_path IS NOT NULL AND file_ord IS NOT NULL")
    version = F.col("file_ord").alias("version")
    gone = named.filter("content IS NULL").select("skill_id", "rel_path", version, *[F.lit(0).cast("long").alias(c) for c in ADDED])
    read = read_contents(named.filter("content IS NOT NULL"), file_detectors() if detectors is None else detectors, ["LOGGING", "ERROR_LOGGING"], ())
    code = F.lower(F.substring_index("rel_path", ".", -1)).isin(*dims.CODE)
    lock = F.lit(False)
    for name in dims.LOCKFILES:
        lock = lock | F.col("rel_path").endswith(name)
    counts = {s: F.size(F.filter(F.transform("hits", lambda h: h["severity"]), _equal_to(s))) for s in SEVERITIES}
    tests = {"code_files": code, "logging_files": code & marked("LOGGING"), "error_logging_files": code & marked("ERROR_LOGGING"), "lockfiles": lock, "ignore_files": F.col("rel_path") == ".gitignore"}
    added = {"files": F.lit(1)} | counts | tests
    return gone.unionByName(read.select("skill_id", "rel_path", version, *[c.cast("long").alias(k) for k, c in added.items()]))


def _equal_to(wanted: str) -> Callable:
    return lambda severity: severity == wanted


def rated(totals: DataFrame) -> DataFrame:
    """The totals with ``security``: 100 less three times the weights of the hits, from 0 to 100."""
    lost = sum((F.col(s) * dims.WEIGHT[s] for s in SEVERITIES), F.lit(0))
    return totals.withColumn("security", clamp(100 - 3 * lost).cast("int"))


def skill_totals(files: DataFrame, detectors: list[Detector | FileCheck] | None = None) -> DataFrame:
    """(skill_id, ADDED, security) over the newest version of each file of a table; skills without files have zeros."""
    newest = file_rows(files, detectors).groupBy("skill_id", "rel_path").agg(F.max_by(F.struct(*ADDED), "version").alias("a"))
    return rated(newest.groupBy("skill_id").agg(*[F.sum(f"a.{c}").alias(c) for c in ADDED]))


class SkillState(StatefulProcessor):
    """One skill: what each file adds, by path, and the sum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.added = handle.getMapState("added", "rel_path string", f"version long, {_NUMBERS}")
        self.total = handle.getValueState("total", _NUMBERS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = list(self.total.get()) if self.total.exists() else [0] * len(ADDED)
        for frame in rows:
            for path, version, *added in frame[["rel_path", "version", *ADDED]].itertuples(index=False):
                held = self.added.getValue((path,)) if self.added.containsKey((path,)) else None
                if held is not None and held[0] >= version:
                    continue  # an older version that comes late, or the same one again
                total = [t - (held[k + 1] if held is not None else 0) + int(n) for k, (t, n) in enumerate(zip(total, added))]
                self.added.updateValue((path,), (int(version), *map(int, added)))
        self.total.update(tuple(total))
        yield pd.DataFrame([[key[0], *total]], columns=["skill_id", *ADDED])

    def close(self) -> None:
        pass


def skill_states(files: DataFrame, detectors: list[Detector | FileCheck] | None = None) -> DataFrame:
    """A stream of files to a stream of totals (as skill_totals): after each batch those of the skills in it.

    A row that is not newer than what is held for its path changes nothing, so
    batches may come again and versions late.  Rows of a skill meet in one task;
    they hold numbers, no contents.  Needs the RocksDB state store, which is set
    in the session.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = file_rows(files, detectors).groupBy("skill_id")
    return rated(rows.transformWithStateInPandas(SkillState(), f"skill_id string, {_NUMBERS}", "Update", "None"))


def follow(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, detectors: list[Detector | FileCheck] | None = None) -> StreamingQuery:
    """Hands the changed totals of each batch to a sink, with the batch's number, until no files are left."""
    states = skill_states(files, detectors)
    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
