"""Registry tables: CSV files with a fixed schema, pipe lists and yes/no columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_pipe
from ..schemas import REGISTRIES

# Columns that hold pipe lists, and columns that hold yes or no.
LISTS = {"task_coverage", "primary_sources", "bundles", "source_groups", "covered_protocols", "main_protocols"}
FLAGS = {"remote_fetchable", "required_for_release", "git_companion_required"}


def read_registry(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One registry; lists lose empty elements, and anything but ``yes`` is false."""
    return typed(spark.read.schema(REGISTRIES[name]).option("header", True).csv(path))


def typed(rows: DataFrame) -> DataFrame:
    return rows.select(*[split_pipe(F.col(c)).alias(c) if c in LISTS else (F.col(c) == "yes").alias(c) if c in FLAGS else F.col(c) for c in rows.columns])


def read_quotas(spark: SparkSession, path: str) -> DataFrame:
    """Quotas by bundle and source, rows without either id left out; a missing file means no quotas."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], REGISTRIES["source-allocation"])
    return read_registry(spark, "source-allocation", path).where("coalesce(bundle_id, '') <> '' and coalesce(source_id, '') <> ''")


def having_protocol(rows: DataFrame, column: str, protocol: str) -> DataFrame:
    return rows.where(F.array_contains(column, protocol))
