"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for sessions that the engine opens itself; a given session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def open_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf's underscores stand for dots."""
    b = SparkSession.builder.appName("siftlake")
    if master:
        b = b.master(master)
    return b.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's spark.checkpoint.dir. Where that is unset a temporary one is made in local mode, as in
    tests; a cluster, whose executors do not share such a folder, is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siftlake-"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_siftlake_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="siftlake-ship-")) / "siftlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("siftlake") / p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._siftlake_shipped = True
