"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and local runs; on a cluster, use the one that is there."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | extra
    return SparkSession.builder.master(master).appName("cleave").config(map=conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; only where it names none, make one for a local run."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cleave-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder; survives lost executors.

    The planner's size estimate starts anew: it multiplies at each join, and in a loop of joins would grow without bound.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def settle(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """`cut` for results that are mostly small: as many files as there are times `rows` rows, however many tasks made them.

    The result waits on the executors' disks until it is counted and written; what a lost executor held is made again.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    out = cut(held.coalesce(max(1, -(-held.count() // rows))))
    held.unpersist()
    return out


def release(spark: SparkSession) -> None:
    """Let go of finished steps: Spark drops their shuffle files and checkpoints only when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, for tables between steps."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a session: their Python workers need it for the operators that run there.

    The archive lies in the driver's own temporary folder; Spark serves it to the executors from there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cleave-package-")) / "cleave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("cleave") / p.relative_to(root)))
    sc.addPyFile(str(archive))
