"""Session defaults, and the shared folder that checkpoints go to."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cadenza-ship-")) / "cadenza.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))


def build_session(app: str = "cadenza", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings every operator is written for."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CADENZA_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


#: Rows that the Parquet writer takes before it looks at the size of a page or row group again.
LOOK_ROWS = 8


def long_rows(spark: SparkSession) -> None:
    """Have Parquet writers of this session look at their memory every few rows; what is set already stays.

    By default they look after 100 to 10,000 rows, by the size of the rows before: where texts of megabytes
    follow short ones, a page was measured at 735 MB. The rows that are written are the same.
    """
    for part in ("page", "block"):
        for end in ("min", "max"):
            name = f"parquet.{part}.size.row.check.{end}"
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, str(LOOK_ROWS))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    The folder is the one named by ``spark.checkpoint.dir``. Only in a local session without it (tests, a
    laptop) is a temporary one made; on a cluster, where that would be one machine's own, it is an error. The copy outlives the executor that wrote it, so a lost
    executor costs no recomputation beyond its own running tasks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder shared by the executors")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cadenza-"))
    return df.checkpoint(eager=eager)
