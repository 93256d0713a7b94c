"""The dataset build end to end: configuration, plan, one scan with fan-out, manifest, shards, cards and ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import registry as R
from ..sources import archives, sinks
from ..shared import drop_cuts
from ..sources.config import StageConfig
from ..sources.runs import Run


@dataclass
class BuildResult:
    """Where a build wrote what, and its numbers."""

    manifest_path: str
    shard_path: str | None
    ledger: DataFrame


def plan(config: StageConfig, sources: DataFrame, status: DataFrame, bundles: DataFrame, allocation: DataFrame) -> DataFrame:
    """``bundle_id, source_id, quota`` of a build: the selected bundles and sources, each bundle with its quotas."""
    chosen = R.select_sources(sources, status, watchlist=config.allow_watchlist)
    if config.sources:
        chosen = chosen.where(F.col("source_id").isin(config.sources))
    wanted = bundles.where(F.col("bundle_id").isin(config.bundles)) if config.bundles else bundles
    pairs = R.bundle_membership(wanted, chosen)
    quotas = allocation.groupBy("bundle_id", "source_id").agg(F.max("target_samples").alias("quota"))
    limits = F.lit(None).cast("int")
    for source, limit in config.source_limits.items():
        limits = F.when(F.col("source_id") == source, limit).otherwise(limits)
    return pairs.join(quotas, ["bundle_id", "source_id"], "left").withColumn("quota", F.least("quota", limits))


class Stopped(RuntimeError):
    """The run's stop flag was set; a later build goes on from the bundles that are published."""


def published_bundles(spark: SparkSession, root: str) -> DataFrame | None:
    """``bundle_id`` of the bundles in a build's ledger; none before there is one."""
    system, at = archives.file_system(f"{root}/ledger")
    if not system.get_file_info(f"{at}/_SUCCESS").is_file:
        return None
    return spark.read.schema("bundle_id string").json(f"{root}/ledger")


def build(spark: SparkSession, config: StageConfig, samples: DataFrame, pairs: DataFrame, *, shards: bool = False, resume: bool = False) -> BuildResult:
    """Write a build: every sample once per bundle that wants it, within quotas. The statistics are those of what was written.

    A build that stops is run again: the manifest is replaced as a whole and shards appear only by the commit. With ``resume`` the bundles in the ledger are left
    as they are, and only the others are built and added. Rows are counted while they are written, for the heartbeat.
    """
    run = Run(spark, config.stage, config.output_root)
    if run.flag("STOP"):
        raise Stopped(f"{run.at('control', 'STOP')} is set")
    run.heartbeat("running")
    done = published_bundles(spark, run.at()) if resume else None
    if done is not None:
        pairs = pairs.join(done, "bundle_id", "left_anti")
    rows = B.fan_out(samples.drop("bundle_id"), pairs, target="bundle_id")
    if "scope" in rows.columns:
        rows = rows.where(B.in_scope(F.col("scope"), F.col("bundle_id"))).drop("scope")
    kept = B.within_quota(rows, ["bundle_id", "source_id"], [F.col("sample_id")], F.col("quota")).drop("quota")
    root = f"{config.output_root}/{config.stage}"
    manifest_path = f"{root}/manifest"
    counted, seen = run.counted(B.manifest(kept), "manifest")
    sinks.write_manifest(counted, manifest_path, mode="append" if done is not None else "overwrite")
    run.heartbeat("running", rows=float(seen.get["rows"]))
    written = spark.read.parquet(manifest_path)
    shard_path = None
    if shards:
        archives.register(spark)
        shard_path = f"{root}/shards"
        sized = written.withColumn("_size", F.coalesce(F.octet_length("canonical_target"), F.lit(0)) + 1000)
        parts = B.shard_buckets(sized, key="bundle_id", spread="sample_id", size="_size", target=config.shard_target_mb << 20)
        one = parts.repartition("bundle_id", "_bucket").sortWithinPartitions("bundle_id", "_bucket", "sample_id").drop("_bucket", "_size")
        archives.shard_rows(one).write.format("shardtar").option("target_bytes", config.shard_target_mb << 20).mode("append").save(shard_path)
    stats = B.bundle_stats(written)
    sinks.write_cards(sinks.bundle_cards(stats, written.select("bundle_id", "source_id")), f"{root}/cards")
    stats.write.mode("overwrite").json(f"{root}/ledger")
    run.summary({"stage": config.stage, "rows": seen.get["rows"]})
    run.heartbeat("finished", rows=float(seen.get["rows"]))
    drop_cuts(spark)  # everything is written
    return BuildResult(manifest_path, shard_path, spark.read.schema(stats.schema).json(f"{root}/ledger"))
