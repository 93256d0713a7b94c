"""Build plans, variants and training groups as tables: waves by profile, completion of bundles, sources that are full, variant projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .build import artifact_group
from .registry import action_rank, priority_rank


def one_profile(profiles: DataFrame, profile_id: str) -> DataFrame:
    """The profile of that name; an unknown one is an error."""
    found = profiles.where(F.col("profile_id") == profile_id).limit(1)
    if not found.take(1):
        raise ValueError(f"there is no build profile named {profile_id}")
    return found


def fetchable(selected: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Selected sources with an endpoint that can be fetched."""
    return selected.join(endpoints.where("remote_fetchable").select("source_id").distinct(), "source_id", "left_semi")


def profile_waves(profiles: DataFrame, bundles: DataFrame, selected: DataFrame, size: int, ranks: dict[str, int] | None = None) -> DataFrame:
    """``profile_id, source_id, plan_position, wave`` of every profile: sources in the order of its bundles, then the other selected ones by action, priority and id.

    Ranked within a profile: the sources are a short list of registered names, profiles are many.
    """
    named = profiles.select("profile_id", F.posexplode("bundles").alias("bundle_pos", "bundle_id")).join(bundles.select("bundle_id", F.posexplode("sources").alias("source_pos", "source_id")), "bundle_id")
    first = named.groupBy("profile_id", "source_id").agg(F.min(F.struct("bundle_pos", "source_pos")).alias("at"))
    listed = selected.agg(F.collect_list(F.struct("source_id", "next_action", "ingestion_priority"))).scalar()
    every = profiles.select("profile_id").distinct().select("profile_id", F.explode(listed).alias("s")).select("profile_id", "s.*")
    key = [F.col("at").isNull(), F.col("at"), action_rank(F.col("next_action"), ranks), priority_rank(F.col("ingestion_priority")), F.col("source_id")]
    placed = every.join(first, ["profile_id", "source_id"], "left").withColumn("plan_position", F.row_number().over(Window.partitionBy("profile_id").orderBy(*key)) - 1)
    wave = F.floor(F.col("plan_position") / size).cast("int") if size > 0 else F.lit(0)
    return placed.select("profile_id", "source_id", "plan_position", wave.alias("wave"))


def with_namespace(bundles: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Bundles with the place that their artifact group is published to; a group without place leaves its bundles out."""
    return bundles.withColumn("artifact_group", artifact_group(F.col("bundle_class"))).join(namespaces.select("artifact_group", "namespace"), "artifact_group")


def bundle_completion(members: DataFrame, plan: DataFrame) -> DataFrame:
    """``bundle_id, last_source, completion``: a bundle is final once the last of its sources in the plan is through; bundles in the order in which they are."""
    last = members.join(plan, "source_id").groupBy("bundle_id").agg(F.max(F.struct("plan_position", "source_id")).alias("l"))
    done = last.select("bundle_id", F.col("l.plan_position").alias("at"), F.col("l.source_id").alias("last_source"))
    return done.withColumn("completion", F.dense_rank().over(Window.orderBy("at"))).drop("at")


def full_sources(written: DataFrame, quotas: DataFrame) -> DataFrame:
    """``source_id``: sources of which every bundle with a quota has got it, so that no more of them need be read."""
    state = quotas.where("quota is not null").join(written, ["bundle_id", "source_id"], "left")
    return state.groupBy("source_id").agg(F.bool_and(F.coalesce("n", F.lit(0)) >= F.col("quota")).alias("full")).where("full").select("source_id")


# Modules whose names begin alike share a scale of the learning rate.
MODULE_SCALES = ("vision_encoder", "layout_side_encoder", "latent_bottleneck", "planner", "writer")


def learning_scale(name: Column, scales: dict[str, float], rest: float = 1.0) -> Column:
    out = F.lit(rest)
    for module in reversed(MODULE_SCALES):
        out = F.when(F.startswith(name, F.lit(module)), scales.get(module, rest)).otherwise(out)
    return out


def without_decay(name: Column) -> Column:
    return F.endswith(name, F.lit(".bias")) | F.contains(name, F.lit(".norm.")) | F.contains(F.lower(name), F.lit("layernorm"))


def backend_family(method: Column) -> Column:
    return (
        F.when(F.startswith(method, F.lit("llmcompressor")), "llmcompressor")
        .when(F.startswith(method, F.lit("torchao")), "torchao")
        .when(method == "runtime_kv_quant", "runtime_only")
        .when(method == "reference_export", "reference")
        .when(method.isNotNull(), "custom")
    )


def variant_plan(variants: DataFrame, default_samples: int) -> DataFrame:
    """Variants with their family and how many samples calibrate them: none where none is required, the stage's number where theirs is missing or zero."""
    own = F.coalesce(F.nullif(F.col("calibration_samples"), F.lit(0)), F.lit(default_samples))
    return variants.withColumns({"family": backend_family(F.col("method")), "calibration_samples": F.when(F.col("requires_calibration"), own).otherwise(0)})


# The two named protocols, with their bundle and modes of decoding.
PROTOCOLS = {"public_frontier": ("public_frontier_v1", "public_frontier_v1", "fast,standard,hard"), "internal_holdout": ("internal_holdout_v1", "internal_holdout", "standard,hard")}


def protocol_of(name: Column) -> Column:
    """Protocol, bundle and modes of a protocol's name; any other name stands for itself, in the standard mode."""
    out = F.when(name.isNotNull(), F.struct(name.alias("protocol"), name.alias("bundle"), F.lit("standard").alias("modes")))
    for short, values in PROTOCOLS.items():
        out = F.when(name == short, F.struct(*[F.lit(v).alias(k) for k, v in zip(("protocol", "bundle", "modes"), values, strict=True)])).otherwise(out)
    return out


def effective_batch(micro: Column, accumulation: Column, devices: Column, tokens: Column) -> tuple[Column, Column]:
    """Samples and tokens of one optimizer step."""
    samples = micro * accumulation * devices
    return samples, samples * tokens
