"""Session, table and materialisation helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SPREAD_PARTITIONS = 64
_SHIPPED: set[str] = set()
_CUTS: list[str] = []


def local_session(app: str = "scriptorium", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; columns are pruned by the optimiser."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small scan (no shuffle in it) over all cores, ahead of work that costs more than moving its rows.

    Only scans of at most ``SPREAD_PARTITIONS`` partitions are moved, some gigabytes at the most; larger tables stay as they are, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    return df.repartition(cores) if parts < min(cores, SPREAD_PARTITIONS + 1) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir, or one of our own where it is unset and the session is local (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = jdir.get() if jdir.isDefined() else None
    if not known and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not known:
        own = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        known = "file://" + own
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as zstd parquet into the shared folder and read it back.

    Cuts the lineage at a file that any executor can read again, so that a lost executor costs the
    tasks it ran and nothing else.
    """
    spark = df.sparkSession
    path = drop_later(f"{shared_dir(spark)}/cut-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_later(path: str) -> str:
    """Note a folder of intermediate results for ``drop_cuts``."""
    _CUTS.append(path)
    return path


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote in this process, once their results are written; returns their number."""
    done = 0
    while _CUTS:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        done += bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True))
    return done


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run (once per context)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="scriptorium-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    atexit.register(lambda: os.path.exists(name) and os.remove(name))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
