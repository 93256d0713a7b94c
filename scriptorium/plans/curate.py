"""Queries of registries, curation and source formats, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import split_pipe, strip
from ..operators import curation as C
from ..operators import registry as R
from ..operators.neardup import near_duplicate_classes
from ..shared import drop_later, shared_dir, spread, table

_B = r"[\s\x0b\x1c-\x1f\x85\pZ]"
_SID = "lower(regexp_replace({}, '^" + _B + "+|" + _B + "+$', '', 'g'))"


def _split(c: str = "split_assignment"):
    low = F.lower(strip(F.col(c)))
    return F.when(low.isin("val", "dev", "validation"), "validation").when(low.isin("train", "test"), low)


_SPLIT_SQL = "CASE lower(trim(split_assignment)) WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'validation' THEN 'validation' WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' END"


# --- registries -------------------------------------------------------------


def _registries(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = table(spark, d, "source_registry")
    sources = s.groupBy("source_id").agg(*[F.max_by(c, "registered_at").alias(c) for c in ("data_class", "ingestion_priority", "license_or_access_status")])
    st = table(spark, d, "source_status").select(F.lower(strip(F.col("source_id"))).alias("source_id"), "current_status", "next_action", "recorded_at", "record_id").where("source_id <> ''")
    status = st.groupBy("source_id").agg(*[F.max_by(c, F.struct("recorded_at", "record_id")).alias(c) for c in ("current_status", "next_action")])
    policy = F.when(F.col("license_or_access_status").isNull(), "manual").when(F.col("license_or_access_status") == "reviewed_open", "automated").otherwise("internal")
    endpoints = sources.where("ingestion_priority <> 'C'").select(
        "source_id", policy.alias("probe_policy"), F.lit("HEAD").alias("probe_method"), F.when(F.col("data_class") != "weak_aux", F.concat(F.lit("https://example.org/"), "source_id")).alias("probe_url"), (F.col("license_or_access_status") == "terms_on_file").alias("remote_fetchable")
    )
    b = table(spark, d, "bundle_registry")
    bundles = b.groupBy("bundle_id").agg(F.max_by(F.struct("stage", "primary_sources"), F.struct("recorded_at", "record_id")).alias("r")).select(
        "bundle_id", "r.stage", F.array_distinct(F.filter(F.transform(split_pipe(F.col("r.primary_sources")), lambda x: F.lower(strip(x))), lambda x: x != "")).alias("sources")
    )
    profiles = bundles.groupBy(F.col("stage").alias("profile_id")).agg(F.array_sort(F.collect_set("bundle_id")).alias("bundles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_groups"))
    return {"sources": sources, "status": status, "endpoints": endpoints, "bundles": bundles, "profiles": profiles}


def registry_audit(spark: SparkSession, d: str) -> DataFrame:
    return R.audit(**_registries(spark, d))


def registry_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.audit_summary(registry_audit(spark, d))


_ACTIONS = {"build_first": 0, "ingest_after_core": 1, "check_terms": 3}


def registry_plan_order(spark: SparkSession, d: str) -> DataFrame:
    r = _registries(spark, d)
    chosen = R.select_sources(r["sources"], r["status"])
    named = r["bundles"].where("stage = 'exact_core'").select(F.col("bundle_id").alias("bundle_pos"), F.posexplode("sources").alias("source_pos", "source_id"))
    return R.waves(R.ranked_sources(chosen, named, _ACTIONS), 4)


def bundle_source_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = _registries(spark, d)
    chosen = R.select_sources(r["sources"], r["status"])
    return R.bundle_membership(r["bundles"], chosen).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("sources"), F.min("source_id").alias("first_source"))


def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_registry")
    return s.groupBy("data_class").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("retired_at").isNull()).alias("in_use"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("source_ids")
    )


def protocol_membership(spark: SparkSession, d: str) -> DataFrame:
    """Sources by each task that their coverage names."""
    s = table(spark, d, "source_registry").select("source_id", F.explode(F.array_distinct(split_pipe(F.col("task_coverage")))).alias("task")).distinct()
    return s.groupBy("task").agg(F.count(F.lit(1)).alias("sources"))


# --- curation -------------------------------------------------------------


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Copies by Latin letters without accents and digits only, as its SQL has it; ``text_dedup`` tells all scripts."""
    return C.exact_duplicates(table(spark, d, "documents"), F.regexp_replace(F.lower(F.col("text")), r"[^a-z0-9]+", " "), "doc_id")


def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Copies by the words of any script; wordless texts are no copies of one another."""
    return C.exact_duplicates(table(spark, d, "documents"), C.word_key(F.col("text")), "doc_id")


def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_classes(spread(table(spark, d, "documents").select("doc_id", "text"))).withColumnRenamed("id", "doc_id")


def formula_and_table_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").select("sample_id", "target_type", "canonical_target").distinct()
    key = F.when(F.col("target_type") == "latex_formula", F.concat(F.lit("formula:"), C.formula_hash(F.col("canonical_target")))).when(F.col("target_type") == "table_markdown", F.concat(F.lit("table:"), C.table_topology(F.col("canonical_target"))))
    return s.withColumn("key", key).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_sample"))


def identity_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Sources once by identity: the name's letters, whatever their case and punctuation."""
    s = table(spark, d, "source_registry").select("source_id", "source_name", "registered_at")
    kept = C.first_by_key(s, C.document_identity(F.col("source_name"), F.lit(""), F.col("source_id")), ["registered_at", "source_id"])
    return kept.select("source_id", "source_name", "registered_at")


def leakage_screen(spark: SparkSession, d: str) -> DataFrame:
    """Documents by how much of an evaluation item's runs of eight words they hold, and what to do with them."""
    def grams(df: DataFrame, key: str) -> DataFrame:
        w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        runs = F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, 8), " ")))
        return df.select(key, w.alias("w")).where("size(w) >= 8").select(key, F.explode(F.array_distinct(runs)).alias("g"))

    items = grams(table(spark, d, "eval_items").select("item_id", "text"), "item_id")
    size = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    # hashes of runs move, not runs; the items' are a fixed small set, joined by the optimiser's choice
    hits = grams(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("k"))
    worst = hits.join(size, "item_id").groupBy("doc_id").agg(F.max(F.col("k") / F.col("n")).alias("share"), F.count(F.lit(1)).alias("items"))
    action = F.when(F.col("share") >= 0.5, "exclude").when(F.col("share") >= 0.2, "hold_for_review").otherwise("keep_but_demote")
    return worst.select("doc_id", F.round("share", 6).alias("share"), "items", action.alias("action"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").where("sample_id is not null").select("sample_id", "doc_id", "canonical_target", _split().alias("split")).distinct()
    return C.leakage_checks(s.where("split = 'train'"), s.where("split in ('validation', 'test')"), id_column="sample_id", family="doc_id", text="canonical_target")


def leakage_actions(spark: SparkSession, d: str) -> DataFrame:
    """Every train sample with the leakage checks it fails, and what follows."""
    return _checks(spark, d).select(F.col("id").alias("sample_id"), F.array_join("checks", ",").alias("checks"), "action")


def sample_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with the gates it does not pass, and its class."""
    names = ["sample_id", "source_id", "doc_id", "page_id", "data_class", "canonical_target", "target_type", "target_char_count", "difficulty_tier", "has_display_math", "has_gfm_table", "asset_media_types", "slice_tags"]
    s = table(spark, d, "canonical_samples").where("sample_id is not null").select(*names).distinct().withColumn("source", F.lower(strip(F.col("source_id"))))
    known = table(spark, d, "source_registry").select(F.col("source_id").alias("source"), F.lit(True).alias("known")).distinct()
    rows = s.join(known, "source", "left").join(_checks(spark, d).select(F.col("id").alias("sample_id"), "action"), "sample_id", "left")
    reasons = C.reject_reasons(C.sample_gates(F.coalesce("known", F.lit(False)), F.col("action")))
    return rows.withColumn("reasons", reasons).select("sample_id", F.array_join("reasons", ",").alias("reasons"), C.promotion(F.col("reasons"), F.col("data_class")).alias("class"))


def bundle_gates(spark: SparkSession, d: str) -> DataFrame:
    """Bundles with their samples, how many of them repeat a target, their slices, and whether all samples pass the gates."""
    s = table(spark, d, "canonical_samples").where("sample_id is not null and bundle_id is not null").select("sample_id", "bundle_id", F.xxhash64(C.word_key(F.col("canonical_target"))).alias("k"), C.word_key(F.col("canonical_target")).isNotNull().alias("has"), "slice_tags").distinct()
    tags = s.select("bundle_id", F.explode("slice_tags").alias("tag")).groupBy("bundle_id").agg(F.count_distinct("tag").alias("slices"))
    copies = s.where("has").groupBy("bundle_id", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("bundle_id").agg(F.sum(F.col("n") - 1).alias("repeated"))
    passed = s.select("sample_id", "bundle_id").join(sample_gates(spark, d), "sample_id").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("reasons") == "").alias("passed"))
    rows = passed.join(copies, "bundle_id", "left").join(tags, "bundle_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("repeated", "slices")}
    return rows.withColumns(zero).select("bundle_id", "samples", "passed", "repeated", "slices", (F.col("passed") == F.col("samples")).alias("accepted"))


def published_copy(spark: SparkSession, d: str) -> DataFrame:
    """The quotas written to their published place: rows that arrived, and whether count and checksum are those of what was sent."""
    import uuid

    rows = table(spark, d, "source_allocation")
    target = drop_later(f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    rows.write.parquet(target)
    before, after = (C.fingerprint(x, rows.columns) for x in (rows, spark.read.parquet(target)))
    both = before.withColumn("at", F.lit("sent")).unionByName(after.withColumn("at", F.lit("arrived")))
    return both.agg(F.max(F.when(F.col("at") == "arrived", F.col("rows"))).alias("rows"), ((F.min("rows") == F.max("rows")) & (F.min("checksum") == F.max("checksum"))).alias("agrees"))


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").withColumn("reasons", C.reject_reasons(C.quality_gates(F.col("text"))))
    return s.select("doc_id", F.array_join("reasons", ",").alias("reasons"), C.promotion(F.col("reasons"), F.col("data_class")).alias("class"))


def bundle_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents of which every document passes all gates."""
    return quality_gates(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.bool_and(F.col("reasons") == "").alias("accepted"), F.count(F.lit(1)).alias("n"))


def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").select("doc_id", _split().alias("split"))
    return C.torn_families(s, "doc_id", "split")


def holdout_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Train samples of documents that no test sample has, by class."""
    s = table(spark, d, "canonical_samples").select("sample_id", "doc_id", "data_class", _split().alias("split")).distinct()
    kept = C.without_holdout(s.where("split = 'train'"), s.where("split = 'test'"), "doc_id")
    return kept.groupBy("data_class").agg(F.count(F.lit(1)).alias("n"))


def mixture_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every stage's mixture by numbers of samples: each class's share of 2,000, by hash."""
    from ..operators.build import once_per_id

    classes = ("exact_pair", "synthetic_exact", "trusted_aux", "multilingual", "weak_aux")
    shares = table(spark, d, "mixture_targets").select("stage_id", F.explode(F.array(*[F.struct(F.lit(c).alias("data_class"), (F.coalesce(f"{c}_pct", F.lit(0)) / 100.0).alias("share")) for c in classes])).alias("x")).select("stage_id", "x.*")
    rows = once_per_id(table(spark, d, "canonical_samples").select("sample_id", "data_class"), "sample_id")
    most = shares.groupBy("data_class").agg(F.max("share").alias("share"))
    # the rows that the largest share of a class takes hold those of every stage: each stage takes the first of them
    kept = C.first_by_hash(rows.join(most, "data_class"), by="data_class", id_column="sample_id", quota=F.floor(F.col("share") * 2000)).select("sample_id", "data_class", "_k")
    return kept.join(shares, "data_class").where(F.col("_k") <= F.floor(F.col("share") * 2000)).select("stage_id", "sample_id", "data_class")


def anchor_draws(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.build import once_per_id

    s = once_per_id(table(spark, d, "canonical_samples").select("sample_id", "data_class"), "sample_id")
    draws = C.anchor_draws(s, anchor=F.col("data_class") == "weak_aux", id_column="sample_id", draws=6000, anchor_share=0.1)
    return draws.groupBy("side", "draw").agg(F.count(F.lit(1)).alias("n"))


def slice_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").select("sample_id", F.coalesce("difficulty_tier", F.lit("unknown")).alias("difficulty"), F.explode("slice_tags").alias("slice")).distinct()
    return C.slice_rollup(s, "difficulty", "slice")


def publish_check(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that must agree between a table and its published copy."""
    s = table(spark, d, "source_allocation")
    return s.agg(F.count(F.lit(1)).alias("rows"), F.sum("target_samples").alias("samples"), F.count_distinct("bundle_id").alias("bundles"))


# --- formats -------------------------------------------------------------


def page_projection(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at two pages of their own letters, by how many characters each page got."""
    s = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    pages = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))
    p = s.select("doc_id", M.projected_pages("text", pages).alias("p"))
    return p.select("doc_id", F.size("p").alias("pages"), F.length(F.get("p", 0)).alias("first_chars"), F.length(F.get("p", 1)).alias("second_chars"))


def shard_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as tar shards and read again."""
    import uuid

    from ..sources.archives import register, shard_rows

    register(spark)
    s = table(spark, d, "canonical_samples").where("canonical_target is not null").select("sample_id", "canonical_target", "target_type", "bundle_id").dropDuplicates(["sample_id"])
    path = drop_later(f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    shard_rows(s).write.format("shardtar").option("target_bytes", 4_000_000).mode("append").save(path)
    back = spark.read.format("shardtar").load(path)
    return back.select("sample_id", F.sha2("target", 256).alias("target_hash"), F.get_json_object("sample_json", "$.bundle_id").alias("bundle_id"))


def multilingual_quota(spark: SparkSession, d: str) -> DataFrame:
    """Pages of five languages under one quota."""
    from ..sources.wiki import multilingual_pages

    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", "lang")
    pages = multilingual_pages(docs, languages=["de", "fr", "es", "it", "nl"], total=100, order="doc_id")
    return pages.select("doc_id", "lang")


def file_split_inference(spark: SparkSession, d: str) -> DataFrame:
    """Splits that file names tell, of names made from bundles and samples."""
    from ..functions.text import split_of_path

    s = table(spark, d, "canonical_samples").where("split_assignment is not null").select(F.concat(F.lit("data/"), F.lower(F.trim("split_assignment")), F.lit("-00000.parquet")).alias("path"))
    return s.groupBy(split_of_path(F.col("path")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """The nations of every region as a pipe table."""
    from ..functions.text import markdown_table

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("l", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return r.join(rows, r["r_regionkey"] == rows["n_regionkey"]).select("r_name", markdown_table(cells).alias("markdown"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        registry_audit, registry_audit_summary, registry_plan_order, bundle_source_fallback, registry_summary, protocol_membership, exact_dedup, text_dedup, near_dedup, formula_and_table_dedup, identity_dedup,
        leakage_screen, leakage_actions, sample_gates, bundle_gates, published_copy, quality_gates, bundle_acceptance, split_disjoint, holdout_exclusion, mixture_sample, anchor_draws, slice_rollup, publish_check, page_projection, shard_roundtrip, multilingual_quota, file_split_inference, markdown_tables,
    )
}

_REG = f"""sources AS (SELECT source_id, arg_max(data_class, registered_at) AS data_class, arg_max(ingestion_priority, registered_at) AS ingestion_priority,
  (SELECT license_or_access_status FROM source_registry r WHERE r.source_id = s.source_id ORDER BY registered_at DESC LIMIT 1) AS lic FROM source_registry s GROUP BY source_id),
 st AS (SELECT {_SID.format('source_id')} AS source_id, current_status, next_action, recorded_at, record_id FROM source_status WHERE {_SID.format('source_id')} <> ''),
 status AS (SELECT source_id, current_status, next_action FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY recorded_at DESC, record_id DESC) AS k FROM st) WHERE k = 1),
 endpoints AS (SELECT source_id, CASE WHEN lic IS NULL THEN 'manual' WHEN lic = 'reviewed_open' THEN 'automated' ELSE 'internal' END AS probe_policy, CASE WHEN data_class <> 'weak_aux' THEN 'u' END AS probe_url, lic = 'terms_on_file' AS remote_fetchable FROM sources WHERE ingestion_priority <> 'C'),
 lb AS (SELECT bundle_id, stage, primary_sources FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY recorded_at DESC, record_id DESC) AS k FROM bundle_registry) WHERE k = 1),
 used AS (SELECT DISTINCT bundle_id, stage, x AS source_id FROM (SELECT bundle_id, stage, {_SID.format('y')} AS x FROM (SELECT bundle_id, stage, unnest(string_split(primary_sources, '|')) AS y FROM lb)) WHERE x <> ''),
 findings AS (
  SELECT 'error' AS severity, 'missing_source_status' AS code, source_id AS subject FROM sources WHERE source_id NOT IN (SELECT source_id FROM status)
  UNION ALL SELECT 'error', 'missing_source_endpoint', source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM endpoints)
  UNION ALL SELECT 'error', 'orphan_source_status', source_id FROM status WHERE source_id NOT IN (SELECT source_id FROM sources)
  UNION ALL SELECT 'error', 'invalid_automated_probe', source_id FROM endpoints WHERE probe_policy = 'automated' AND probe_url IS NULL
  UNION ALL SELECT 'error', 'invalid_probe_policy', source_id FROM endpoints WHERE probe_policy = 'internal' AND remote_fetchable
  UNION ALL SELECT 'error', 'unknown_bundle_source', bundle_id || '/' || source_id FROM used WHERE source_id NOT IN (SELECT source_id FROM sources)
  UNION ALL SELECT 'warning', 'manual_fetch_path', e.source_id FROM endpoints e JOIN sources s USING (source_id) WHERE data_class IN ('exact_pair', 'trusted_aux') AND probe_policy = 'manual')"""
_GATES = """CASE WHEN NOT (length(trim(t)) > 0) THEN 'gate_not_empty' END, CASE WHEN NOT (length(regexp_replace(t, '[^\\pL]+', '', 'g')) * 4 >= length(t)) THEN 'gate_letters' END,
 CASE WHEN NOT ((length(t) - length(replace(t, '```', ''))) % 6 = 0) THEN 'gate_fences' END, CASE WHEN NOT ((len(string_split(regexp_replace(t, '\\\\.', '', 'gs'), '$')) - 1) % 2 = 0) THEN 'gate_math' END,
 CASE WHEN contains(t, '�') THEN 'gate_encoding' END, CASE WHEN length(t) > 200000 THEN 'gate_length' END"""
_QG = f"""q AS (SELECT doc_id, source, data_class, list_filter([{_GATES}], lambda x: x IS NOT NULL) AS r FROM (SELECT *, coalesce(text, '') AS t FROM documents))"""
_GRAMS = "{0} AS (SELECT DISTINCT {1}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM (SELECT {1}, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM {2}) WHERE len(w) >= 8)"
_ONE = "SELECT sample_id, min(data_class) AS data_class FROM canonical_samples WHERE sample_id IS NOT NULL GROUP BY 1"
_LATEX = f"regexp_replace(replace(regexp_replace(regexp_replace(canonical_target, '^{_B}+|{_B}+$', '', 'g'), '{_B}+', ' ', 'g'), chr(92) || ',', ' '), '^{_B}+|{_B}+$', '', 'g')"
_BARS = "list_filter(string_split(canonical_target, chr(10)), lambda x: starts_with(trim(x), '|'))"
_KEY = "nullif(trim(regexp_replace(lower({0}), '[^\\pL\\pM\\pN]+', ' ', 'g')), '')"
_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def _shingles(n: int) -> str:
    return f"CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) END"


_LEAKS = f"""lk AS (SELECT DISTINCT sample_id, doc_id, canonical_target AS x, {_SPLIT_SQL} AS s, string_split(ltrim(canonical_target, ' '), chr(10))[1] AS h FROM canonical_samples WHERE sample_id IS NOT NULL),
 lw AS (SELECT sample_id, doc_id, s, CASE WHEN starts_with(h, '#') THEN {_KEY.format('h')} END AS t, {_KEY.format('x')} AS k, {_WORDS.format('x')} AS w FROM lk), ls AS (SELECT *, {_shingles(8)} AS sh FROM lw),
 held AS (SELECT * FROM ls WHERE s IN ('validation', 'test')), own AS (SELECT * FROM ls WHERE s = 'train'), hg AS (SELECT DISTINCT unnest(sh) AS g FROM held),
 met AS (SELECT sample_id, count(*) AS met FROM (SELECT DISTINCT sample_id, unnest(sh) AS g FROM own) WHERE g IN (SELECT g FROM hg) GROUP BY 1),
 c AS (SELECT own.*, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM held WHERE doc_id IS NOT NULL) AS identifier, t IS NOT NULL AND t IN (SELECT t FROM held WHERE t IS NOT NULL) AS title, k IS NOT NULL AND k IN (SELECT k FROM held WHERE k IS NOT NULL) AS target, coalesce(met >= 0.8 * len(sh), false) AS near_target FROM own LEFT JOIN met USING (sample_id)),
 checks AS (SELECT *, coalesce(doc_id IS NOT NULL AND sum(CASE WHEN title OR target OR near_target THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) - CASE WHEN title OR target OR near_target THEN 1 ELSE 0 END > 0, false) AS family FROM c),
 actions AS (SELECT *, CASE WHEN identifier OR target THEN 'exclude' WHEN title OR near_target THEN 'hold_for_review' WHEN family THEN 'keep_but_demote' ELSE 'keep' END AS action FROM checks)"""
_PIECES = "(length(x) - length(replace(x, '{0}', '')))"
_SG = f"""{_LEAKS}, sg AS (SELECT DISTINCT sample_id, source_id, doc_id, page_id, data_class, coalesce(canonical_target, '') AS x, canonical_target IS NULL AS none, target_type, target_char_count, difficulty_tier, coalesce(has_display_math OR has_gfm_table, false) AS structured, asset_media_types, slice_tags FROM canonical_samples WHERE sample_id IS NOT NULL),
 gates AS (SELECT sg.sample_id, data_class, list_filter([
  CASE WHEN NOT (coalesce({_SID.format('source_id')} IN (SELECT source_id FROM source_registry), false) AND (page_id IS NULL OR sg.doc_id IS NULL OR regexp_replace(page_id, ':[^:]*$', '') = sg.doc_id)) THEN 'source' END,
  CASE WHEN NOT (regexp_replace(x, '^{_B}+|{_B}+$', '', 'g') <> '' AND target_type IS NOT NULL) THEN 'target' END, CASE WHEN {_PIECES.format('```')} % 6 <> 0 THEN 'markdown' END,
  CASE WHEN (len(string_split(regexp_replace(x, '\\\\.', '', 'gs'), '$')) - 1) % 2 <> 0 OR {_PIECES.format('{')} <> {_PIECES.format('}')} THEN 'latex' END,
  CASE WHEN NOT (page_id IS NULL OR coalesce(len(list_filter(asset_media_types, lambda m: starts_with(m, 'image/'))) > 0, false)) THEN 'picture' END,
  CASE WHEN NOT coalesce(target_char_count = length(x) AND target_char_count BETWEEN 1 AND 200000, false) THEN 'length' END,
  CASE WHEN NOT (difficulty_tier IS NOT NULL AND (NOT structured OR coalesce(len(slice_tags), 0) > 0)) THEN 'difficulty' END, CASE WHEN coalesce(action, 'keep') NOT IN ('keep', 'keep_but_demote') THEN 'leakage' END], lambda g: g IS NOT NULL) AS r FROM sg LEFT JOIN actions USING (sample_id))"""
SQL: dict[str, str] = {
    "near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), s AS (SELECT doc_id, list_sort({_shingles(5)}) AS sh FROM w WHERE len(w) > 0), reps AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s GROUP BY sh),
 x AS (SELECT rep, n, unnest(sh) AS g FROM reps), p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
 e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p), reach AS (SELECT u AS n, u AS m FROM e UNION SELECT reach.n, e.v FROM reach JOIN e ON reach.m = e.u), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY 1), deg AS (SELECT u, count(*) AS k FROM e GROUP BY 1)
 SELECT d.doc_id, coalesce(c, rep, d.doc_id) AS class_id, coalesce(k, 0) AS links FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN reps USING (sh) LEFT JOIN comp ON comp.n = rep LEFT JOIN deg ON u = rep""",
    "leakage_actions": f"WITH {_LEAKS} SELECT sample_id, array_to_string(list_filter([CASE WHEN identifier THEN 'identifier' END, CASE WHEN title THEN 'title' END, CASE WHEN target THEN 'target' END, CASE WHEN near_target THEN 'near_target' END, CASE WHEN family THEN 'family' END], lambda g: g IS NOT NULL), ',') AS checks, action FROM actions",
    "sample_gates": f"WITH {_SG} SELECT sample_id, array_to_string(r, ',') AS reasons, CASE WHEN len(r) > 1 THEN 'reject' WHEN len(r) = 1 THEN 'hold' WHEN data_class = 'exact_pair' THEN 'gold_exact' WHEN data_class IN ('synthetic_exact', 'multilingual') THEN 'silver_exact' ELSE 'aux' END AS class FROM gates",
    "bundle_gates": f"""WITH {_SG}, b AS (SELECT DISTINCT sample_id, bundle_id, {_KEY.format('canonical_target')} AS k, slice_tags FROM canonical_samples WHERE sample_id IS NOT NULL AND bundle_id IS NOT NULL), t AS (SELECT bundle_id, count(DISTINCT tag) AS slices FROM (SELECT bundle_id, unnest(slice_tags) AS tag FROM b) GROUP BY 1),
 r AS (SELECT bundle_id, CAST(sum(n - 1) AS BIGINT) AS repeated FROM (SELECT bundle_id, k, count(*) AS n FROM b WHERE k IS NOT NULL GROUP BY 1, 2) GROUP BY 1), q AS (SELECT bundle_id, count(*) AS samples, count(*) FILTER (len(r) = 0) AS passed FROM (SELECT DISTINCT sample_id, bundle_id FROM b) JOIN gates USING (sample_id) GROUP BY 1)
 SELECT bundle_id, samples, passed, coalesce(repeated, 0) AS repeated, coalesce(slices, 0) AS slices, passed = samples AS accepted FROM q LEFT JOIN r USING (bundle_id) LEFT JOIN t USING (bundle_id)""",
    "published_copy": "SELECT count(*) AS rows, true AS agrees FROM source_allocation",
    "text_dedup": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\pL\\pM\\pN]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '' GROUP BY t HAVING count(*) > 1",
    "formula_and_table_dedup": f"""SELECT key, count(*) AS n, min(sample_id) AS first_sample FROM (SELECT sample_id, CASE WHEN target_type = 'latex_formula' THEN 'formula:' || sha256({_LATEX}) WHEN target_type = 'table_markdown' AND len({_BARS}) > 0 THEN 'table:' || sha256(array_to_string(list_transform({_BARS}, lambda x: length(x) - length(replace(x, '|', ''))), ',')) END AS key
 FROM (SELECT DISTINCT sample_id, target_type, canonical_target FROM canonical_samples)) WHERE key IS NOT NULL GROUP BY 1""",
    "registry_audit": f"WITH {_REG} SELECT * FROM findings",
    "registry_audit_summary": f"WITH {_REG} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM findings",
    "registry_plan_order": f"""WITH {_REG}, chosen AS (SELECT * FROM sources JOIN status USING (source_id) WHERE data_class <> 'weak_aux' AND current_status = 'approved'),
 pos AS (SELECT bundle_id, source_id, p FROM (SELECT bundle_id, {_SID.format('unnest(string_split(primary_sources, chr(124)))')} AS source_id, generate_subscripts(string_split(primary_sources, '|'), 1) AS p FROM lb WHERE stage = 'exact_core') WHERE source_id <> ''),
 firsts AS (SELECT source_id, min((bundle_id, p)) AS place FROM pos GROUP BY 1),
 k AS (SELECT c.source_id, row_number() OVER (ORDER BY place IS NULL, place, CASE next_action WHEN 'build_first' THEN 0 WHEN 'ingest_after_core' THEN 1 WHEN 'check_terms' THEN 3 ELSE 9 END, CASE ingestion_priority WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 9 END, c.source_id) - 1 AS plan_position FROM chosen c LEFT JOIN firsts USING (source_id))
 SELECT source_id, plan_position, CAST(plan_position // 4 AS INT) AS wave FROM k""",
    "bundle_source_fallback": f"""WITH {_REG}, chosen AS (SELECT source_id FROM sources JOIN status USING (source_id) WHERE data_class <> 'weak_aux' AND current_status = 'approved'),
 kept AS (SELECT bundle_id, source_id FROM used WHERE source_id IN (SELECT source_id FROM chosen)), allb AS (SELECT bundle_id, source_id FROM kept UNION ALL SELECT bundle_id, c.source_id FROM lb, chosen c WHERE bundle_id NOT IN (SELECT bundle_id FROM kept))
 SELECT bundle_id, count(*) AS sources, min(source_id) AS first_source FROM allb GROUP BY 1""",
    "registry_summary": "SELECT data_class, count(*) AS rows, count(DISTINCT source_id) AS sources, count(*) FILTER (retired_at IS NULL) AS in_use, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_ids FROM source_registry GROUP BY 1",
    "protocol_membership": "SELECT task, count(DISTINCT source_id) AS sources FROM (SELECT source_id, unnest(string_split(task_coverage, '|')) AS task FROM source_registry) WHERE task <> '' GROUP BY 1",
    "exact_dedup": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL) GROUP BY t HAVING count(*) > 1",
    "identity_dedup": """SELECT source_id, source_name, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY registered_at, source_id) AS n FROM (SELECT *, CASE WHEN length(trim(nm)) >= 12 THEN 'title:' || trim(nm) ELSE 'url:' || lower(source_id) END AS k
 FROM (SELECT *, lower(regexp_replace(source_name, '[^\\pL\\pN]+', ' ', 'g')) AS nm FROM source_registry))) WHERE n = 1""",
    "leakage_screen": f"""WITH {_GRAMS.format('ig', 'item_id', 'eval_items')}, {_GRAMS.format('dg', 'doc_id', 'documents')}, n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN ig USING (g) GROUP BY 1, 2),
 w AS (SELECT doc_id, max(k / n) AS share, count(*) AS items FROM h JOIN n USING (item_id) GROUP BY 1) SELECT doc_id, round(share, 6) AS share, items, CASE WHEN share >= 0.5 THEN 'exclude' WHEN share >= 0.2 THEN 'hold_for_review' ELSE 'keep_but_demote' END AS action FROM w""",
    "quality_gates": f"""WITH {_QG} SELECT doc_id, array_to_string(r, ',') AS reasons, CASE WHEN len(r) > 1 THEN 'reject' WHEN len(r) = 1 THEN 'hold' WHEN data_class = 'exact_pair' THEN 'gold_exact' WHEN data_class IN ('synthetic_exact', 'multilingual') THEN 'silver_exact' ELSE 'aux' END AS class FROM q""",
    "bundle_acceptance": f"WITH {_QG} SELECT source, bool_and(len(r) = 0) AS accepted, count(*) AS n FROM q GROUP BY 1",
    "split_disjoint": f"SELECT doc_id, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT doc_id, {_SPLIT_SQL} AS s FROM canonical_samples) WHERE doc_id IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1",
    "holdout_exclusion": f"""WITH s AS (SELECT DISTINCT sample_id, doc_id, data_class, {_SPLIT_SQL} AS s FROM canonical_samples)
 SELECT data_class, count(*) AS n FROM s WHERE s = 'train' AND (doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM s WHERE s = 'test' AND doc_id IS NOT NULL)) GROUP BY 1""",
    "mixture_sample": f"""WITH sh AS (SELECT stage_id, c.data_class, coalesce(CASE c.data_class WHEN 'exact_pair' THEN exact_pair_pct WHEN 'synthetic_exact' THEN synthetic_exact_pct WHEN 'trusted_aux' THEN trusted_aux_pct WHEN 'multilingual' THEN multilingual_pct ELSE weak_aux_pct END, 0) / 100.0 AS share
 FROM mixture_targets, (VALUES ('exact_pair'), ('synthetic_exact'), ('trusted_aux'), ('multilingual'), ('weak_aux')) c(data_class)), r AS (SELECT s.*, share, stage_id, row_number() OVER (PARTITION BY stage_id, data_class ORDER BY sha256(sample_id), sample_id) AS k FROM ({_ONE}) s JOIN sh USING (data_class)) SELECT stage_id, sample_id, data_class FROM r WHERE k <= floor(share * 2000)""",
    "anchor_draws": f"""WITH s AS (SELECT *, CASE WHEN data_class = 'weak_aux' THEN 'anchor' ELSE 'primary' END AS side FROM ({_ONE})), n AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY sha256(sample_id), sample_id) - 1 AS n, count(*) OVER (PARTITION BY side) AS size FROM s),
 t AS (SELECT side, unnest(range(1, CAST(ceil((CASE side WHEN 'anchor' THEN 600 ELSE 5400 END - n) / size) AS BIGINT) + 1)) AS draw FROM n WHERE ceil((CASE side WHEN 'anchor' THEN 600 ELSE 5400 END - n) / size) > 0) SELECT side, CAST(draw AS INT) AS draw, count(*) AS n FROM t GROUP BY 1, 2""",
    "slice_rollup": """SELECT difficulty, slice, count(*) AS n, CAST(grouping(difficulty) * 2 + grouping(slice) AS BIGINT) AS level FROM (SELECT DISTINCT sample_id, coalesce(difficulty_tier, 'unknown') AS difficulty, unnest(slice_tags) AS slice FROM canonical_samples) GROUP BY ROLLUP (difficulty, slice)""",
    "publish_check": "SELECT count(*) AS rows, CAST(sum(target_samples) AS BIGINT) AS samples, count(DISTINCT bundle_id) AS bundles FROM source_allocation",
    "multilingual_quota": """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE lang IN ('de', 'fr', 'es', 'it', 'nl') AND length(text) >= 1500
 AND regexp_matches(string_split(text, chr(10))[1], '[^\\s\\pZ]') AND len(regexp_extract_all(text, '\\n\\s*\\n')) >= 2) WHERE k <= 20""",
    "file_split_inference": "SELECT CASE WHEN l IN ('val', 'dev', 'validation') THEN 'validation' WHEN l = 'test' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM (SELECT lower(trim(split_assignment)) AS l FROM canonical_samples WHERE split_assignment IS NOT NULL) GROUP BY 1",
    "markdown_tables": "SELECT r_name, '| key | name |' || chr(10) || '| :--- | :--- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "shard_roundtrip": "SELECT DISTINCT sample_id, sha256(canonical_target) AS target_hash, bundle_id FROM canonical_samples WHERE canonical_target IS NOT NULL",
}
