"""Queries of the dataset build over canonical samples and registries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_pipe, strip, target_features
from ..operators import build as B
from ..shared import spread, table

# --- shared views -------------------------------------------------------------


def once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Samples, each once however often it was delivered."""
    return table(spark, d, "canonical_samples").select("sample_id", *columns).where("sample_id is not null").distinct()


def _bundle_sources(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bundle_registry")
    latest = b.where("primary_sources is not null").groupBy("bundle_id").agg(F.max_by("primary_sources", F.struct("recorded_at", "record_id")).alias("s"))
    named = latest.select("bundle_id", F.explode(F.array_distinct(F.transform(split_pipe(F.col("s")), lambda x: F.lower(strip(x))))).alias("source_id")).where("source_id <> ''")
    return named.join(_quotas(spark, d), ["bundle_id", "source_id"], "left").select("bundle_id", "source_id", "quota")


def _quotas(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "source_allocation").where("target_samples > 0")
    return a.groupBy("bundle_id", _sid().alias("source_id")).agg(F.max("target_samples").alias("quota")).where("source_id is not null")


_B = r"[\s\x0b\x1c-\x1f\x85\pZ]"
_TRIM = f"lower(regexp_replace({{}}, '^{_B}+|{_B}+$', '', 'g'))"
_SID_SQL = _TRIM.format("source_id")
_SOURCES_SQL = f"""
latest AS (SELECT bundle_id, arg_max(primary_sources, (recorded_at, record_id)) AS s FROM bundle_registry WHERE primary_sources IS NOT NULL GROUP BY 1),
named AS (SELECT DISTINCT bundle_id, {_TRIM.format('x')} AS source_id FROM (SELECT bundle_id, unnest(string_split(s, '|')) AS x FROM latest) WHERE {_TRIM.format('x')} <> ''),
quotas AS (SELECT bundle_id, {_SID_SQL} AS source_id, max(target_samples) AS quota FROM source_allocation WHERE target_samples > 0 AND source_id IS NOT NULL GROUP BY 1, 2),
bundle_sources AS (SELECT n.bundle_id, n.source_id, q.quota FROM named n LEFT JOIN quotas q USING (bundle_id, source_id))"""


def _sid(c: str = "source_id"):
    return F.lower(strip(F.col(c)))


# --- queries -------------------------------------------------------------


def manifest_record(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("canonical_target_hash"), *[c.alias(n) for n, c in target_features(t).items()])


def bundle_fanout_stats(spark: SparkSession, d: str, documents: bool = True) -> DataFrame:
    s = once(spark, d, "source_id", "doc_id", "page_id", "target_char_count").withColumn("source_id", _sid())
    return B.fan_out_stats(s, _bundle_sources(spark, d), ["sample_id"], documents=documents)


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    scope = table(spark, d, "source_registry").groupBy("source_id").agg(F.max_by("task_coverage", "registered_at").alias("scope"))
    rows = once(spark, d, "source_id", "task_family").withColumn("source_id", _sid()).join(scope, "source_id")
    kept = rows.where(B.in_scope(F.split("scope", r"\|"), F.col("task_family")))
    return kept.groupBy("source_id", "task_family").agg(F.count(F.lit(1)).alias("n"))


def source_limit_quota(spark: SparkSession, d: str) -> DataFrame:
    limits = B.source_limits(_quotas(spark, d).withColumnRenamed("quota", "target_samples"))
    rows = once(spark, d, "source_id").withColumn("source_id", _sid()).where("source_id is not null").join(limits, "source_id", "left")
    kept = B.within_quota(rows, ["source_id"], [F.col("sample_id")], F.coalesce("quota", F.lit(250)))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("sample_id").alias("last_sample"))


TOP = 500


def topk_approved(spark: SparkSession, d: str) -> DataFrame:
    # scored where they are read: no text is shuffled to tell deliveries apart
    score = F.coalesce(B.approval_score(F.col("canonical_target"), F.col("slice_tags"), F.col("page_id")), F.lit(0))
    s = table(spark, d, "canonical_samples").where("sample_id is not null").select("sample_id", score.alias("score"), "slice_tags").distinct()
    rows = B.approved_samples(s, TOP)
    return rows.select("sample_id", "difficulty_tier", F.array_join("slice_tags", "|").alias("tags"))


RECIPES = ["rotate_90", "rotate_270", "low_contrast", "jpeg", "blur", "screen_photo"]
EXPANDED = 9000


def synthetic_expand(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").where(F.exists("asset_media_types", lambda m: F.startswith(m, F.lit("image/")))).select("sample_id").where("sample_id is not null").distinct()
    made = B.synthetic_expansion(s, RECIPES, EXPANDED)
    return made.select(F.concat_ws("-", "sample_id", "recipe", F.lpad(F.col("emission").cast("string"), 7, "0")).alias("synthetic_id"), "recipe", "emission")


def failure_repair_join(spark: SparkSession, d: str) -> DataFrame:
    failures = table(spark, d, "canonical_samples").where("transform_recipe is not null").select(
        F.col("bundle_id").alias("source_bundle_id"), F.col("sample_id").alias("source_sample_id"), F.col("transform_recipe").alias("failure_type"), F.lit(None).cast("string").alias("target_block"), F.reverse("canonical_target").alias("corrupted_prediction")
    )
    rows = B.repair_rows(failures, once(spark, d, "bundle_id", "canonical_target", "slice_tags"))
    return rows.select("source_bundle_id", "source_sample_id", "failure_type", F.length("corrupted_prediction").alias("corrupted_chars"), F.array_join("slice_tags", "|").alias("tags"))


PACKS, PACK_CAP = ((B.GENERAL, "general_sft", 2000), (B.SPECIALIST, "specialist_sft", 1800), (B.REPAIR, "repair_sft", 1000)), 4000


def prompt_pack_union(spark: SparkSession, d: str) -> DataFrame:
    s = once(spark, d, "bundle_id", "data_class")
    rows = B.prompt_packs([(pack, s.where(F.startswith("bundle_id", F.lit(prefix))), q) for pack, prefix, q in PACKS], PACK_CAP)
    return rows.select("pack", "sample_id", "data_class", "prompt")


def artifact_groups(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bundle_registry")
    return b.groupBy(B.artifact_group(F.concat_ws(" ", "bundle_class", "stage")).alias("artifact_group")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bundle_id").alias("bundles"))


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    # documents are no part of the totals
    return bundle_fanout_stats(spark, d, documents=False).agg(F.sum("sample_count").alias("samples"), F.sum("page_count").alias("pages"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("bundles"))


SHARD_CHARS = 40_000


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "bundle_id", "target_char_count", "target_type").where("bundle_id is not null").withColumn("size", F.coalesce("target_char_count", F.lit(0)).cast("bigint") + 200)
    numbered = B.shard_numbers(rows, key="bundle_id", order=["sample_id"], size="size", target=SHARD_CHARS)
    return numbered.groupBy("bundle_id", "shard").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("size"), F.min("sample_id").alias("first_sample"), F.count_if(B.target_extension(F.col("target_type")) == "md").alias("markdown_members"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (manifest_record, bundle_fanout_stats, scope_filter, source_limit_quota, topk_approved, synthetic_expand, failure_repair_join, prompt_pack_union, artifact_groups, run_totals, shard_assignment)
}

_LE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_ONCE = "(SELECT DISTINCT {} FROM canonical_samples WHERE sample_id IS NOT NULL)"
_FANOUT = f"""WITH {_SOURCES_SQL}, s AS (SELECT DISTINCT sample_id, {_SID_SQL} AS source_id, doc_id, page_id, target_char_count FROM canonical_samples),
fan AS (SELECT b.bundle_id AS target_bundle, s.*, b.quota, row_number() OVER (PARTITION BY b.bundle_id, s.source_id ORDER BY s.sample_id) AS k FROM s JOIN bundle_sources b USING (source_id)),
stats AS (SELECT target_bundle, count(*) AS sample_count, count(DISTINCT doc_id) AS document_count, count(page_id) AS page_count, CAST(sum(target_char_count) AS BIGINT) AS size FROM fan WHERE quota IS NULL OR k <= quota GROUP BY 1)"""
_SCORE = """(CASE WHEN length(canonical_target) >= 256 THEN 3 ELSE 0 END + CASE WHEN contains(canonical_target, '$$') THEN 2 ELSE 0 END + CASE WHEN contains(canonical_target, '| ') THEN 2 ELSE 0 END
 + CASE WHEN list_has_any(slice_tags, ['formula','table','multilingual','dense_formula','merged_cells']) THEN 1 ELSE 0 END + CASE WHEN page_id IS NOT NULL THEN 1 ELSE 0 END)"""

SQL: dict[str, str] = {
    "shard_assignment": f"""WITH RECURSIVE r AS (SELECT *, coalesce(target_char_count, 0) + 200 AS size, row_number() OVER (PARTITION BY bundle_id ORDER BY sample_id) AS k FROM (SELECT DISTINCT sample_id, bundle_id, target_char_count, target_type FROM canonical_samples WHERE sample_id IS NOT NULL AND bundle_id IS NOT NULL)),
 f AS (SELECT bundle_id, k, sample_id, target_type, size, 0 AS shard, size AS filled FROM r WHERE k = 1
  UNION ALL SELECT r.bundle_id, r.k, r.sample_id, r.target_type, r.size, f.shard + CASE WHEN f.filled > 0 AND f.filled + r.size > {SHARD_CHARS} THEN 1 ELSE 0 END, CASE WHEN f.filled + r.size > {SHARD_CHARS} THEN r.size ELSE f.filled + r.size END FROM f JOIN r ON r.bundle_id = f.bundle_id AND r.k = f.k + 1)
 SELECT bundle_id, shard, count(*) AS members, CAST(sum(size) AS BIGINT) AS size, min(sample_id) AS first_sample, count(*) FILTER (contains(target_type, 'markdown')) AS markdown_members FROM f GROUP BY 1, 2""",
    "manifest_record": f"""SELECT doc_id, sha256(text) AS canonical_target_hash, length(text) AS target_char_count, contains(text, '$$') AS has_display_math,
 len(string_split(regexp_replace(text, '\\$\\$+', '#', 'g'), '$')) - 1 >= 2 AS has_inline_math,
 len(list_filter(string_split_regex(text, '{_LE}'), lambda x: regexp_matches(x, '^{_B}*\\|(.*\\|)?{_B}*$', 's'))) > 0 AS has_gfm_table, contains(text, '```table') AS has_table_block,
 regexp_matches(text, '(?i)(^|\\n)figure:{_B}') AS has_figure_caption, regexp_matches(text, '(^|\\n)#{{1,6}}{_B}') AS has_heading, regexp_matches(text, '(^|\\n){_B}*[-*]{_B}') AS has_list FROM documents""",
    "bundle_fanout_stats": f"{_FANOUT} SELECT * FROM stats",
    "run_totals": f"{_FANOUT} SELECT CAST(sum(sample_count) AS BIGINT) AS samples, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(size) AS BIGINT) AS size, count(*) AS bundles FROM stats",
    "scope_filter": f"""WITH allsrc AS (SELECT source_id, (SELECT task_coverage FROM source_registry r WHERE r.source_id = a.source_id ORDER BY registered_at DESC LIMIT 1) AS scope FROM (SELECT DISTINCT source_id FROM source_registry) a)
 SELECT s.source_id, s.task_family, count(*) AS n FROM (SELECT DISTINCT sample_id, {_SID_SQL} AS source_id, task_family FROM canonical_samples) s JOIN allsrc USING (source_id)
 WHERE scope IS NULL OR list_contains(string_split(scope, '|'), s.task_family) GROUP BY 1, 2""",
    "source_limit_quota": f"""WITH {_SOURCES_SQL}, lim AS (SELECT source_id, max(quota) AS quota FROM quotas GROUP BY 1),
 r AS (SELECT s.*, coalesce(quota, 250) AS q, row_number() OVER (PARTITION BY source_id ORDER BY sample_id) AS k FROM (SELECT DISTINCT sample_id, {_SID_SQL} AS source_id FROM canonical_samples WHERE source_id IS NOT NULL) s LEFT JOIN lim USING (source_id))
 SELECT source_id, count(*) AS n, max(sample_id) AS last_sample FROM r WHERE k <= q GROUP BY 1""",
    "topk_approved": f"""WITH s AS {_ONCE.format('sample_id, canonical_target, slice_tags, page_id')},
 top AS (SELECT sample_id FROM s ORDER BY coalesce({_SCORE}, 0) DESC, sha256(sample_id), sample_id DESC LIMIT {TOP})
 SELECT sample_id, CASE WHEN list_has_any(slice_tags, ['formula','table','dense_formula','merged_cells']) THEN 'hard' ELSE 'medium' END AS difficulty_tier,
  array_to_string(list_filter(list_append(slice_tags, 'approved_exact'), lambda x, i: list_position(list_append(slice_tags, 'approved_exact'), x) = i), '|') AS tags FROM s WHERE sample_id IN (SELECT sample_id FROM top)""",
    "synthetic_expand": f"""WITH s AS (SELECT DISTINCT sample_id FROM canonical_samples WHERE len(list_filter(asset_media_types, lambda m: starts_with(m, 'image/'))) > 0),
 e AS (SELECT sample_id, pass, row_number() OVER (ORDER BY pass, sample_id) - 1 AS emission FROM s, range({EXPANDED}) t(pass) WHERE pass * (SELECT count(*) FROM s) < {EXPANDED}),
 r AS (SELECT *, ({RECIPES!r})[pass % {len(RECIPES)} + 1] AS recipe FROM e WHERE emission < {EXPANDED})
 SELECT concat_ws('-', sample_id, recipe, lpad(CAST(emission AS VARCHAR), 7, '0')) AS synthetic_id, recipe, emission FROM r""",
    "failure_repair_join": f"""SELECT f.bundle_id AS source_bundle_id, f.sample_id AS source_sample_id, f.transform_recipe AS failure_type, length(f.canonical_target) AS corrupted_chars,
  array_to_string(list_concat(['repair', f.transform_recipe], s.slice_tags), '|') AS tags
 FROM canonical_samples f JOIN {_ONCE.format('sample_id, bundle_id, slice_tags')} s USING (bundle_id, sample_id) WHERE f.transform_recipe IS NOT NULL""",
    "prompt_pack_union": f"""WITH s AS {_ONCE.format('sample_id, bundle_id, data_class')},
 g AS (SELECT 'general' AS pack, sample_id, 'gold_exact' AS data_class FROM s WHERE starts_with(bundle_id, 'general_sft') ORDER BY sample_id LIMIT 2000),
 p AS (SELECT 'specialist' AS pack, sample_id, data_class FROM s WHERE starts_with(bundle_id, 'specialist_sft') ORDER BY sample_id LIMIT 1800),
 r AS (SELECT 'repair' AS pack, sample_id, data_class FROM s WHERE starts_with(bundle_id, 'repair_sft') ORDER BY sample_id LIMIT 1000),
 u AS (SELECT *, 0 AS branch FROM g UNION ALL SELECT *, 1 FROM p UNION ALL SELECT *, 2 FROM r)
 SELECT pack, sample_id, data_class, CASE WHEN pack = 'repair' THEN 'Repair the damaged block so that it matches the page.' ELSE 'Parse the page into Markdown with LaTeX.' END AS prompt
 FROM (SELECT * FROM u ORDER BY branch, sample_id LIMIT {PACK_CAP})""",
    "artifact_groups": """SELECT CASE WHEN contains(c, 'holdout') THEN 'holdout_bundle' WHEN contains(c, 'aux') THEN 'aux_bundle' WHEN contains(c, 'synthetic') THEN 'synthetic_bundle' ELSE 'exact_bundle' END AS artifact_group,
 count(*) AS n, count(DISTINCT bundle_id) AS bundles FROM (SELECT *, concat_ws(' ', bundle_class, stage) AS c FROM bundle_registry) GROUP BY 1""",
}
