"""Session settings and the shared working folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class EngineError(ValueError):
    """Raised for input the engine refuses (the message says why)."""


def build_session(app: str = "loamline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling; cluster settings win where they are set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    }.items():
        b = b.config(key, value)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context, whatever their path holds."""
    context = spark.sparkContext
    if getattr(context, "_loamline_shipped", False):
        return
    root, stage = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="loamline-ship-"))
    shutil.copytree(root, stage / "pack" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(stage / f"{root.name}_{uuid.uuid4().hex[:8]}"), "zip", stage / "pack"))
    context._loamline_shipped = True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder.  All stored times are zone-free and mean UTC, so the session is put on UTC."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset and the session runs on this machine
    alone (tests) a local one.  Without it a cluster is refused: each executor would write to a disk of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="loamline-")
    return shared_folder.own


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``purge`` removes all that were given out."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    given = getattr(spark.sparkContext, "_loamline_paths", [])
    spark.sparkContext._loamline_paths = [*given, path]
    return path


def purge(spark: SparkSession) -> None:
    """Delete the intermediate tables of this context.  Results that were not yet written can't be read afterwards."""
    for path in getattr(spark.sparkContext, "_loamline_paths", []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._loamline_paths = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
