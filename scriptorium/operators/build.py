"""Dataset build: manifest, fan-out of sources to bundles, quotas, statistics, derived bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_hash, target_features
from ..schemas import MANIFEST, columns_of
from ..shared import cut
from .skew import HOT

GENERAL, SPECIALIST, REPAIR = "general", "specialist", "repair"


def manifest(samples: DataFrame) -> DataFrame:
    """The manifest of canonical samples: hash and structural features of the target, assets without their payload."""
    t = F.col("canonical_target")
    made = samples.withColumns({"canonical_target_hash": stable_hash(t), **target_features(t)})
    if "assets" in samples.columns:
        made = made.withColumns({"asset_names": F.transform("assets", lambda a: a["name"]), "asset_media_types": F.transform("assets", lambda a: a["media_type"])})
    return made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in columns_of(MANIFEST)])


def asset_size(asset: Column) -> Column:
    return F.coalesce(F.octet_length(asset["payload_bytes"]), F.octet_length(asset["text_payload"]), F.lit(0))


def primary_image(assets: Column) -> Column:
    return F.get(F.filter(assets, lambda a: F.startswith(a["media_type"], F.lit("image/"))), 0)


def fan_out(samples: DataFrame, bundle_sources: DataFrame, *, source: str = "source_id", target: str = "target_bundle") -> DataFrame:
    """Each sample once for every bundle that its source feeds: one scan, whatever the number of bundles."""
    pairs = bundle_sources.select(F.col("source_id").alias(source), F.col("bundle_id").alias(target), "quota")
    return samples.join(pairs, source)


def in_scope(scope: Column, member: Column) -> Column:
    """A scope list restricts to its members; without one everything is in scope."""
    return scope.isNull() | F.array_contains(scope, member)


def within_quota(rows: DataFrame, keys: list[str], order: list[Column], quota: Column, most: int | None = None, hot: int = HOT) -> DataFrame:
    """The first rows of every group, as many as its quota (null: all, which are not ranked).

    ``most``, where it is known, is the largest quota there is: up to the engine's limit for it, groups are cut to that number where they are read, before
    any shuffle. Otherwise groups are counted (combined where the rows are): if one has more than ``hot`` rows, all are ranked by range, that is, rows are
    sorted by key and order over all tasks, so that no task sorts a hot group; if none has, a group is a task's window. The result is the same.
    """
    wanted = rows.where(quota.isNotNull())
    ranked = wanted.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if most is not None and most < int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        ranked = ranked.where(F.col("_rank") <= int(most))
    elif wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).take(1):
        by = [f"_by{i}" for i in range(len(order))]
        ranked = number_rows(wanted.select("*", *[c.alias(n) for c, n in zip(order, by, strict=True)]), by, "_rank", keys).drop(*by).withColumn("_rank", F.col("_rank") + 1)
    return ranked.where(F.col("_rank") <= quota).drop("_rank").unionByName(rows.where(quota.isNull()))


def source_limits(allocation: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``source_id, quota``: the largest quota of a source over the active bundles."""
    rows = allocation if active is None else allocation.join(active, "bundle_id", "left_semi")
    return rows.groupBy("source_id").agg(F.max("target_samples").alias("quota"))


def bundle_stats(rows: DataFrame, bundle: str = "bundle_id", bytes_column: str | None = None) -> DataFrame:
    """Samples, distinct documents, page rows and bytes of every bundle."""
    size = F.sum(bytes_column) if bytes_column else F.sum("target_char_count")
    return rows.groupBy(bundle).agg(F.count(F.lit(1)).alias("sample_count"), F.count_distinct("doc_id").alias("document_count"), F.count("page_id").alias("page_count"), size.alias("size"))


BAND = 256
"""Ranks of a source that are met with its quotas at once."""


def fan_out_stats(samples: DataFrame, bundle_sources: DataFrame, order: list[str], *, source: str = "source_id", target: str = "target_bundle", band: int = BAND, documents: bool = True) -> DataFrame:
    """``bundle_stats`` of the fan-out within its quotas, none of whose rows is made: it grows as samples times bundles.

    A sample's rank in its source is the same for every bundle. Each source is ranked once (by range, whatever its size), summed up between one quota and
    the next, and the sums are added up along the ranks: a pair of bundle and source takes those at its quota. Samples meet quotas by bands of ranks, so
    that no key is hot. A document counts at its first rank; what bundles count once for each of several sources is taken off again, by groups of documents
    that stand in the same sources between the same quotas. Pairs are distinct; rows equal in ``order`` are ranked by what is counted.
    That correction alone can grow as groups of documents times bundles; without ``documents`` they are not counted and it is not made.
    """
    counted = samples.where(F.col(source).isNotNull()).select(source, *order, "doc_id", F.col("page_id").isNotNull().cast("bigint").alias("_pages"), F.col("target_char_count").cast("bigint").alias("_size"))
    numbered = number_rows(counted, [*order, "doc_id", "_pages", "_size"], "_rank", [source]).withColumn("_rank", F.col("_rank") + 1)
    ranked = cut(numbered.select(source, "_rank", *["doc_id"] * documents, "_pages", "_size"), "ranked")
    sizes = ranked.groupBy(source).agg(F.max("_rank").alias("_n"))
    pairs = bundle_sources.select(F.col("bundle_id").alias(target), F.col("source_id").alias(source), "quota").join(sizes, source)
    pairs = cut(pairs.select(target, source, F.least(F.coalesce("quota", "_n"), "_n").alias("_upto")).where("_upto > 0"), "pairs")

    along = Window.partitionBy(source).orderBy("_upto")
    ends = pairs.select(source, "_upto").distinct().withColumn("_from", F.coalesce(F.lag("_upto").over(along), F.lit(0)))
    bands = ends.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_from") / band), F.floor((F.col("_upto") - 1) / band))))

    def placed(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("_band", F.floor((F.col("_rank") - 1) / band)).join(bands, [source, "_band"])
        return met.where((F.col("_from") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))

    names = {"_samples": "sample_count", "_docs": "document_count", "_pages": "page_count", "_size": "size"}
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    items = ranked.select(source, "_rank", one.alias("_samples"), none.alias("_docs"), "_pages", "_size")
    if documents:
        docs = ranked.where("doc_id is not null").groupBy(source, "doc_id").agg(F.min("_rank").alias("_rank"))
        items = items.unionByName(docs.select(source, "_rank", none.alias("_samples"), one.alias("_docs"), none.alias("_pages"), F.lit(None).cast("bigint").alias("_size")))
    sums = [*names]
    steps = placed(items).groupBy(source, "_upto").agg(*[F.sum(c).alias(c) for c in sums])
    parts = pairs.join(steps.select(source, "_upto", *[F.sum(c).over(along).alias(c) for c in sums]), [source, "_upto"]).select(target, *sums)
    if not documents:
        return parts.groupBy(target).agg(*[F.sum(c).alias(n) for c, n in names.items() if c != "_docs"])

    groups = placed(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), F.col("_upto").alias("u")))).alias("_in")).where(F.size("_in") > 1)
    groups = groups.groupBy("_in").agg(F.min("doc_id").alias("_doc"), F.count(F.lit(1)).alias("_k"))
    twos = groups.select("_doc", "_k", "_in", F.explode("_in").alias("_a"))
    twos = twos.select("_doc", "_k", "_a", F.explode(F.expr("filter(_in, x -> x.s > _a.s)")).alias("_b"))
    a, b = (pairs.select(F.col(target).alias(f"_t{x}"), F.col(source).alias(f"_s{x}"), F.col("_upto").alias(f"_u{x}")) for x in "ab")
    both = a.join(b, F.col("_ta").eqNullSafe(F.col("_tb")) & (F.col("_sa") < F.col("_sb")))
    met = twos.join(both, (F.col("_a.s") == F.col("_sa")) & (F.col("_b.s") == F.col("_sb"))).where("_a.u <= _ua and _b.u <= _ub")
    # of m sources of a bundle that have the document, m (m - 1) / 2 pairs are met: it was counted m - 1 times too often
    often = met.groupBy(F.col("_ta").alias(target), "_doc").agg(F.first("_k").alias("_k"), F.count(F.lit(1)).alias("_met"))
    often = often.withColumn("_docs", -F.col("_k") * F.round((F.sqrt(F.col("_met") * 8 + 1) - 1) / 2).cast("bigint"))
    less = often.select(target, none.alias("_samples"), "_docs", none.alias("_pages"), F.lit(None).cast("bigint").alias("_size"))
    return parts.unionByName(less).groupBy(target).agg(*[F.sum(c).alias(n) for c, n in names.items()])


def artifact_group(bundle_class: Column) -> Column:
    """Holdout before auxiliary before synthetic before exact; the order matters."""
    return (
        F.when(F.contains(bundle_class, F.lit("holdout")), "holdout_bundle")
        .when(F.contains(bundle_class, F.lit("aux")), "aux_bundle")
        .when(F.contains(bundle_class, F.lit("synthetic")), "synthetic_bundle")
        .otherwise("exact_bundle")
    )


# --- derived bundles -------------------------------------------------------------

# Tags whose samples count as formula, table or multilingual material.
SCORED_TAGS = ("formula", "table", "multilingual", "dense_formula", "merged_cells")
APPROVED_TAG = "approved_exact"


def approval_score(target: Column, tags: Column, page: Column) -> Column:
    return (
        F.when(F.length(target) >= 256, 3).otherwise(0)
        + F.when(F.contains(target, F.lit("$$")), 2).otherwise(0)
        + F.when(F.contains(target, F.lit("| ")), 2).otherwise(0)
        + F.when(F.arrays_overlap(tags, F.array(*map(F.lit, SCORED_TAGS))), 1).otherwise(0)
        + F.when(page.isNotNull(), 1).otherwise(0)
    )


def approved_top(samples: DataFrame, k: int) -> DataFrame:
    """``sample_id, score`` of the k best samples (scored already, or by target, tags and page); ties go to the smaller hash of the id, then to the larger id."""
    scored = samples.select("sample_id", "score") if "score" in samples.columns else samples.select("sample_id", F.coalesce(approval_score(F.col("canonical_target"), F.col("slice_tags"), F.col("page_id")), F.lit(0)).alias("score"))
    return scored.orderBy(F.desc("score"), F.sha2("sample_id", 256), F.desc("sample_id")).limit(k)


def approved_samples(samples: DataFrame, k: int) -> DataFrame:
    """The best samples themselves (semi-join), with their difficulty and the tag that marks them."""
    rows = samples.join(approved_top(samples, k).select("sample_id"), "sample_id", "left_semi")
    hard = F.arrays_overlap("slice_tags", F.array(F.lit("formula"), F.lit("table"), F.lit("dense_formula"), F.lit("merged_cells")))
    return rows.withColumns({"difficulty_tier": F.when(hard, "hard").otherwise("medium"), "slice_tags": F.array_distinct(F.concat("slice_tags", F.array(F.lit(APPROVED_TAG))))})


def number_rows(rows: DataFrame, order: list[str], out: str = "index", keys: list[str] | None = None) -> DataFrame:
    """``rows`` with their number from 0 in the given order, of all rows or of those with equal ``keys``.

    Rows are range-sorted (by key and order) and written; each part is numbered on its own and shifted by the sizes of the parts before it. No task sees more
    than its range, whatever a key holds. Rows with a null key are numbered as well, as one more key.
    """
    keys = keys or []
    parts = cut(rows.orderBy(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col(k).isNull().alias(f"_o{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))] + [f"_o{i}" for i in range(len(keys))]
    parts = parts.select("*", *same)
    sizes = parts.groupBy("_part", *names).agg(F.count(F.lit(1)).alias("_n"))
    # a key has a row for each part it reaches into
    shifts = sizes.select("_part", *names, (F.sum("_n").over(Window.partitionBy(*names).orderBy("_part")) - F.col("_n")).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part", *names).orderBy(*order)) - 1
    parts = parts.withColumn("_inside", inside).join(shifts, ["_part", *names]).drop(*names)
    return parts.withColumn(out, F.col("_shift") + F.col("_inside")).drop("_part", "_inside", "_shift")


def synthetic_expansion(samples: DataFrame, recipes: list[str], target: int, order: str = "sample_id") -> DataFrame:
    """Passes of recipes over samples until ``target`` rows are made, numbered in order of emission (pass, then sample).

    A sample's numbers follow from its place among all samples, so the expansion is not sorted. Without samples nothing is made.
    """
    numbered = number_rows(samples, [order])
    n = F.lit(samples.count()).cast("bigint")
    passes = F.ceil((F.lit(target) - F.col("index")) / n)
    rows = numbered.where(F.col("index") < target).withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
    names = F.array(*map(F.lit, recipes))
    made = rows.withColumns({"emission": F.col("_pass") * n + F.col("index"), "recipe": F.get(names, F.pmod(F.col("_pass"), F.lit(len(recipes))).cast("int"))})
    return made.drop("_pass", "index")


def repair_rows(failures: DataFrame, samples: DataFrame) -> DataFrame:
    """Failures joined to the samples they came from; every failure row gives a row, the failure's tags come first and stay repeated."""
    s = samples.select(F.col("bundle_id").alias("source_bundle_id"), F.col("sample_id").alias("source_sample_id"), "canonical_target", "slice_tags")
    return failures.join(s, ["source_bundle_id", "source_sample_id"]).select(
        "source_bundle_id", "source_sample_id", "failure_type", "corrupted_prediction", F.coalesce("target_block", "canonical_target").alias("canonical_target"), F.concat(F.array(F.lit("repair"), F.col("failure_type")), "slice_tags").alias("slice_tags")
    )


def prompt_packs(branches: list[tuple[str, DataFrame, int]], cap: int, order: str = "sample_id") -> DataFrame:
    """The union of branches, each within its quota, up to ``cap`` rows in the order of the branches.

    Quotas and the cap are top-k operations; nothing is ranked in one window.
    """
    parts = [rows.orderBy(order).limit(quota).withColumns({"pack": F.lit(pack), "_branch": F.lit(i)}) for i, (pack, rows, quota) in enumerate(branches)]
    rows = reduce(DataFrame.unionByName, parts).orderBy("_branch", order).limit(cap).drop("_branch")
    prompt = F.when(F.col("pack") == REPAIR, "Repair the damaged block so that it matches the page.").otherwise("Parse the page into Markdown with LaTeX.")
    return rows.withColumns({"prompt": prompt, "data_class": F.when(F.col("pack") == GENERAL, "gold_exact").otherwise(F.col("data_class"))})


# --- shards -------------------------------------------------------------


SHARDS_PER_TASK, SHARD_STEP = 256, 1 << 20


def shard_buckets(rows: DataFrame, *, key: str, spread: str, size: str, target: int) -> DataFrame:
    """``rows`` with ``_bucket``: a key of more than ``SHARDS_PER_TASK`` shards falls into as many parts as it takes, by hash."""
    wanted = F.ceil(F.sum(F.coalesce(size, F.lit(0))) / F.lit(target * SHARDS_PER_TASK)).cast("int")
    parts = rows.groupBy(F.col(key).alias("_key")).agg(wanted.alias("_parts")).where("_parts > 1")
    split = rows.join(parts, rows[key] == parts["_key"], "left").drop("_key")
    return split.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def shard_numbers(rows: DataFrame, *, key: str, order: list[str], size: str, target: int, out: str = "shard") -> DataFrame:
    """Shards filled in order and closed before they overflow; a row larger than the target fills one alone.

    The sum restarts at every overflow, which no window frame expresses. The fold runs where the rows are, over
    each key's sorted rows and with a state of two numbers. A key too large for one task is split by hash first (``shard_buckets``): its parts are
    filled on their own and numbered from multiples of ``SHARD_STEP``.
    """
    rows = shard_buckets(rows, key=key, spread=order[0], size=size, target=target)
    import pyarrow as pa

    columns = [*rows.columns]
    schema = rows.schema.simpleString()[len("struct<") : -1]
    at_key, at_size, at_bucket = columns.index(key), columns.index(size), columns.index("_bucket")

    def run(batches):
        last, filled, number = object(), 0, 0
        for b in batches:
            got = []
            for k, n, bucket in zip(*(b.column(c).to_pylist() for c in (at_key, at_size, at_bucket)), strict=True):
                if (k, bucket) != last:
                    last, filled, number = (k, bucket), 0, bucket * SHARD_STEP
                n = n or 0
                if filled and filled + n > target:
                    number, filled = number + 1, 0
                filled += n
                got.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int32())], names=[*columns, out])

    return rows.repartition(key, "_bucket").sortWithinPartitions(key, "_bucket", *order).mapInArrow(run, f"{schema},{out}:int").drop("_bucket")


def target_extension(target_type: Column) -> Column:
    return F.when(F.contains(target_type, F.lit("markdown")), "md").otherwise("txt")


def once_per_id(rows: DataFrame, id_column: str) -> DataFrame:
    """One row per id: where deliveries differ, the smallest of them as a whole."""
    rest = [c for c in rows.columns if c != id_column]
    return rows.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(F.struct(*rest)).alias("_r")).select(id_column, "_r.*")
