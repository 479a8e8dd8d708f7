"""Session defaults and the one place where lineage is cut."""
from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "panelyard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE on, UTC)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # small inputs on one machine: keep all cores busy instead of coalescing to one task
            b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
            b = b.config("spark.sql.shuffle.partitions", "8").config(
                "spark.driver.memory", os.environ.get("PANELYARD_DRIVER_MEMORY", "8g")
            )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package; on one machine they share the driver's files."""
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="panelyard-"), "panelyard")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "panelyard"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a driver that is its own executor may use a temporary folder of its machine; on a
    cluster the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelyard-ckpt-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
