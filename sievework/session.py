"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "sievework", cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIEVEWORK_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary folder of this machine, which only a
    local master can use: on any other RuntimeError is raised.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_KEY)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievework-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that the loss of an executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like `cut`, as a compressed table of columns: smaller, and later reads take only the columns they need.

    What was shuffled for it is removed once it is written. The table stays in the shared folder under a name of its own until the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_tables() -> None:
    for spark, path in _tables:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # noqa: BLE001 - this session may be gone, and with it the way to its folder; others may not be
            continue


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once an application, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sievework-code-")) / "sievework_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
