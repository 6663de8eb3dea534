"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows that go to a Python task at a time, where the session's settings name no number. Texts are
#: long, and Spark's own 10,000 of them can fill hundreds of megabytes twice over.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000
#: Bytes of such rows, for tables of long rows; Spark's own number is 64 MB, some of which stays with the executor.
BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 * 1024 * 1024

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(
    app: str = "wrenlight", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings the jobs expect.

    Shuffle partitions are left to the caller: on a cluster set
    ``spark.sql.shuffle.partitions`` high and let AQE coalesce.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there
    the driver's disk is the executors' disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    # In "local-cluster" executors are processes of their own.
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="wrenlight-")
    return _local_dirs[context.applicationId]


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch for Python tasks in this session, unless its settings do."""
    if not spark.sparkContext.getConf().contains(BATCH_SIZE):
        spark.conf.set(BATCH_SIZE, BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python tasks, in case it isn't installed where they run.

    Also bounds the rows of a batch in this session, unless its settings do.
    """
    context = spark.sparkContext
    if not context.getConf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="wrenlight-"))) / "wrenlight.zip"
    with zipfile.ZipFile(archive, "w") as zipped:
        for file in sorted(package.rglob("*.py")):
            zipped.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
