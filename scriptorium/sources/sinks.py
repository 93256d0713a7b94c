"""Sinks: manifests by bundle, bundle cards, ledgers, predictions, run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifest(rows: DataFrame, path: str, *, bundle: str = "bundle_id", max_records: int = 1_000_000, mode: str = "overwrite") -> None:
    """The manifest in one folder per bundle; the bundle's column also stays in the files. An empty manifest keeps its schema."""
    spread = rows.withColumn("bundle", F.col(bundle)).repartition("bundle", F.pmod(F.xxhash64("sample_id"), F.lit(16)))
    spread.write.partitionBy("bundle").option("maxRecordsPerFile", max_records).mode(mode).parquet(path)


def bundle_cards(stats: DataFrame, sources: DataFrame) -> DataFrame:
    """One JSON document per bundle: its numbers and its sources in order."""
    lists = sources.groupBy("bundle_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return stats.join(lists, "bundle_id", "left").select("bundle_id", F.to_json(F.struct("bundle_id", "source_ids", "sample_count", "document_count", "page_count", "size")).alias("card"))


def write_cards(cards: DataFrame, path: str) -> None:
    cards.write.mode("overwrite").partitionBy("bundle_id").text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A small control document, sorted and indented, on any file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray((json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n").encode()))
    finally:
        out.close()


def publish(rows: DataFrame, target: str) -> dict[str, int]:
    """Write a table to its published place and check count and checksum of what arrived."""
    from ..operators.curation import fingerprint

    before = fingerprint(rows, rows.columns).first().asDict()
    rows.write.mode("overwrite").parquet(target)
    after = fingerprint(rows.sparkSession.read.parquet(target), rows.columns).first().asDict()
    if before != after:
        raise RuntimeError(f"published table differs: {before} and {after}")
    return after


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
