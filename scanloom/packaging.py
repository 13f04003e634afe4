"""The package on the executors, and batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes handed to Python at once; files may have up to a megabyte, texts even more.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Used only by a local master, where the session names no shared folder (tests).
LOCAL_FOLDER = "/tmp/checkpoints"
_SHIPPED: set[str] = set()


def ready_for_python(spark: SparkSession) -> None:
    """Sends the package through the context, once, and bounds Arrow batches in rows and bytes.

    The bounds are settings of the session and stay there: results are lazy, and
    the settings hold when they are computed.  Lower bounds that are set stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key).rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    shipped = Path(tempfile.mkdtemp(prefix=package.name)) / f"{package.name}.zip"
    with zipfile.ZipFile(shipped, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(shipped))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, for tables and files between steps.

    Where it is unset, a local folder if all tasks run in this process, and an
    error on a cluster: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_FOLDER
