"""Queries of build plans, variants and training groups, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import planning as N
from ..operators import registry as R
from ..operators.scoring import first_names
from ..shared import table
from .curate import _ACTIONS, _REG, _SID, _registries


def _chosen(r: dict[str, DataFrame]) -> DataFrame:
    return N.fetchable(R.select_sources(r["sources"], r["status"]), r["endpoints"].where("probe_url is not null").withColumn("remote_fetchable", F.lit(True)))


def profile_waves(spark: SparkSession, d: str) -> DataFrame:
    """Every stage as a profile: its sources in waves of four."""
    r = _registries(spark, d)
    return N.profile_waves(r["profiles"], r["bundles"], _chosen(r), 4, _ACTIONS)


def bundle_namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Where each recorded bundle is published."""
    places = spark.createDataFrame([(g, f"warehouse/{g}s") for g in ("holdout_bundle", "aux_bundle", "synthetic_bundle", "exact_bundle")], "artifact_group string, namespace string")
    return N.with_namespace(table(spark, d, "bundle_registry").select("record_id", "bundle_id", "bundle_class"), places).select("record_id", "bundle_id", "namespace")


def bundle_completion(spark: SparkSession, d: str) -> DataFrame:
    """When each bundle is final if sources are worked off by name."""
    r = _registries(spark, d)
    plan = r["sources"].select("source_id", F.dense_rank().over(Window.orderBy("source_id")).alias("plan_position"))
    return N.bundle_completion(r["bundles"].select("bundle_id", F.explode("sources").alias("source_id")).distinct(), plan)


def full_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose samples fill all the quotas of their bundles."""
    from .build import _quotas, _sid

    s = table(spark, d, "canonical_samples").where("sample_id is not null").select("sample_id", "bundle_id", _sid().alias("source_id")).distinct()
    return N.full_sources(s.groupBy("bundle_id", "source_id").agg(F.count(F.lit(1)).alias("n")), _quotas(spark, d))


_MODULES = ("vision_encoder", "layout_side_encoder", "latent_bottleneck", "planner", "writer", "heads")
_TAILS = ("block.weight", "block.bias", "norm.scale", "LayerNorm.g")
_SCALES = {"vision_encoder": 0.2, "layout_side_encoder": 0.5, "latent_bottleneck": 0.8, "planner": 1.0, "writer": 1.2}


def parameter_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts as parameters of modules: sums and first names by learning scale and decay."""
    p = table(spark, d, "part")
    name = F.concat_ws(".", F.get(F.array(*map(F.lit, _MODULES)), F.col("p_size") % 6), F.col("p_partkey").cast("string"), F.get(F.array(*map(F.lit, _TAILS)), (F.col("p_partkey") % 4).cast("int")))
    rows = p.select(name.alias("name"), F.col("p_size").cast("bigint").alias("n")).withColumns({"lr_scale": N.learning_scale(F.col("name"), _SCALES, 1.5), "weight_decay": F.when(N.without_decay(F.col("name")), 0.0).otherwise(0.1)})
    return first_names(rows, ["lr_scale", "weight_decay"], "name", "n")


def variant_plan(spark: SparkSession, d: str) -> DataFrame:
    """Parts as variants: family and calibration samples."""
    methods = F.array(*map(F.lit, ("llmcompressor_w8a8", "torchao_int4", "runtime_kv_quant", "reference_export", "own", None)))
    v = table(spark, d, "part").select("p_partkey", F.get(methods, F.col("p_size") % 6).alias("method"), (F.col("p_size") % 2 == 0).alias("requires_calibration"), (F.col("p_size") % 3 * 64).alias("calibration_samples"))
    return N.variant_plan(v, 256)


def protocol_modes(spark: SparkSession, d: str) -> DataFrame:
    """Protocols of the evaluation families, and of the two named ones."""
    names = table(spark, d, "eval_items").select(F.col("dataset_family").alias("name")).distinct().unionByName(spark.createDataFrame([("public_frontier",), ("internal_holdout",)], "name string"))
    return names.select("name", N.protocol_of(F.col("name")).alias("p")).select("name", "p.*")


def training_batches(spark: SparkSession, d: str) -> DataFrame:
    """Mixture stages as training stages: samples and tokens of a step."""
    samples, tokens = N.effective_batch(F.coalesce("max_repeat", F.lit(1)), F.coalesce("multilingual_pct", F.lit(0)) + 1, F.lit(8), F.lit(4096))
    return table(spark, d, "mixture_targets").select("stage_id", samples.cast("bigint").alias("samples"), tokens.cast("bigint").alias("tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (profile_waves, bundle_namespaces, bundle_completion, full_sources, parameter_groups, variant_plan, protocol_modes, training_batches)}

_CASES = "CASE {0} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODULES)) + " END"
SQL: dict[str, str] = {
    "profile_waves": f"""WITH {_REG}, chosen AS (SELECT * FROM sources JOIN status USING (source_id) WHERE data_class <> 'weak_aux' AND current_status = 'approved' AND source_id IN (SELECT source_id FROM endpoints WHERE probe_url IS NOT NULL)),
 pos AS (SELECT stage, bundle_id, source_id, p FROM (SELECT stage, bundle_id, {_SID.format('unnest(string_split(primary_sources, chr(124)))')} AS source_id, generate_subscripts(string_split(primary_sources, '|'), 1) AS p FROM lb) WHERE source_id <> ''),
 firsts AS (SELECT stage, source_id, min((bundle_id, p)) AS place FROM pos GROUP BY 1, 2), profiles AS (SELECT DISTINCT stage FROM lb),
 k AS (SELECT f.stage, c.source_id, row_number() OVER (PARTITION BY f.stage ORDER BY place IS NULL, place, CASE next_action WHEN 'build_first' THEN 0 WHEN 'ingest_after_core' THEN 1 WHEN 'check_terms' THEN 3 ELSE 9 END, CASE ingestion_priority WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 9 END, c.source_id) - 1 AS plan_position FROM profiles f CROSS JOIN chosen c LEFT JOIN firsts ON firsts.stage = f.stage AND firsts.source_id = c.source_id)
 SELECT stage AS profile_id, source_id, plan_position, CAST(plan_position // 4 AS INT) AS wave FROM k""",
    "bundle_namespaces": "SELECT record_id, bundle_id, 'warehouse/' || CASE WHEN contains(bundle_class, 'holdout') THEN 'holdout' WHEN contains(bundle_class, 'aux') THEN 'aux' WHEN contains(bundle_class, 'synthetic') THEN 'synthetic' ELSE 'exact' END || '_bundles' AS namespace FROM bundle_registry",
    "bundle_completion": f"""WITH {_REG}, plan AS (SELECT source_id, dense_rank() OVER (ORDER BY source_id) AS place FROM sources), l AS (SELECT bundle_id, max((place, source_id)) AS m FROM used JOIN plan USING (source_id) GROUP BY 1)
 SELECT bundle_id, m[2] AS last_source, dense_rank() OVER (ORDER BY m[1]) AS completion FROM l""",
    "full_sources": f"""WITH q AS (SELECT bundle_id, {_SID.format('source_id')} AS source_id, max(target_samples) AS quota FROM source_allocation WHERE target_samples > 0 AND source_id IS NOT NULL GROUP BY 1, 2),
 w AS (SELECT bundle_id, {_SID.format('source_id')} AS source_id, count(DISTINCT sample_id) AS n FROM canonical_samples WHERE source_id IS NOT NULL GROUP BY 1, 2) SELECT source_id FROM q LEFT JOIN w USING (bundle_id, source_id) GROUP BY 1 HAVING bool_and(coalesce(n, 0) >= quota)""",
    "parameter_groups": f"""WITH p AS (SELECT {_CASES.format('p_size % 6')} AS m, p_partkey, p_size, p_partkey % 4 AS t FROM part),
 g AS (SELECT CASE m WHEN 'vision_encoder' THEN 0.2 WHEN 'layout_side_encoder' THEN 0.5 WHEN 'latent_bottleneck' THEN 0.8 WHEN 'planner' THEN 1.0 WHEN 'writer' THEN 1.2 ELSE 1.5 END::DOUBLE AS lr_scale, CASE WHEN t = 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS weight_decay, p_size, m || '.' || p_partkey || '.' || CASE t WHEN 0 THEN 'block.weight' WHEN 1 THEN 'block.bias' WHEN 2 THEN 'norm.scale' ELSE 'LayerNorm.g' END AS name FROM p)
 SELECT lr_scale, weight_decay, CAST(sum(p_size) AS BIGINT) AS total, array_to_string(list_sort(list(DISTINCT name))[1:5], ',') AS names FROM g GROUP BY 1, 2""",
    "variant_plan": """SELECT p_partkey, method, rc AS requires_calibration, CASE method WHEN 'llmcompressor_w8a8' THEN 'llmcompressor' WHEN 'torchao_int4' THEN 'torchao' WHEN 'runtime_kv_quant' THEN 'runtime_only' WHEN 'reference_export' THEN 'reference' WHEN 'own' THEN 'custom' END AS family,
 CASE WHEN NOT rc THEN 0 WHEN s = 0 THEN 256 ELSE s END AS calibration_samples FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'llmcompressor_w8a8' WHEN 1 THEN 'torchao_int4' WHEN 2 THEN 'runtime_kv_quant' WHEN 3 THEN 'reference_export' WHEN 4 THEN 'own' END AS method, p_size % 2 = 0 AS rc, p_size % 3 * 64 AS s FROM part)""",
    "protocol_modes": """SELECT DISTINCT dataset_family AS name, dataset_family AS protocol, dataset_family AS bundle, 'standard' AS modes FROM eval_items UNION ALL VALUES ('public_frontier', 'public_frontier_v1', 'public_frontier_v1', 'fast,standard,hard'), ('internal_holdout', 'internal_holdout_v1', 'internal_holdout', 'standard,hard')""",
    "training_batches": "SELECT stage_id, CAST(coalesce(max_repeat, 1) * (coalesce(multilingual_pct, 0) + 1) * 8 AS BIGINT) AS samples, CAST(coalesce(max_repeat, 1) * (coalesce(multilingual_pct, 0) + 1) * 8 * 4096 AS BIGINT) AS tokens FROM mixture_targets",
}
