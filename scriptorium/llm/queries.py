"""The registered queries of the training-data operators; each works on its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table
from .form import changed_values, normalise_column
from .languages import document_languages, language_stretches, wrong_labels
from .leaks import WINDOW, leaked_items
from .mixture import bundle_weights, mix, mixture_shares, sample_units, sort_mixture, stage_weights
from .overlap import overlap_counts, overlapping_pairs
from .records import collapse_records, record_members
from .splits import assign_splits, split_report, torn_groups
from .tokens import encode_documents


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_samples")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return record_members(_samples(spark, d)).select(F.col("first_id").alias("first_sample_id"), F.col("id").alias("sample_id"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record once, with its smallest sample and its number of samples."""
    return collapse_records(_samples(spark, d)).select("first_id", "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_values(_samples(spark, d), ["canonical_target", "source_id"])


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every sample's target and source in form."""
    rows = _samples(spark, d).select("sample_id", "canonical_target", "source_id").distinct()
    done = normalise_column(normalise_column(rows, "canonical_target", "target_form", "target_kinds"), "source_id", "source_form", "source_kinds")
    return done.select("sample_id", "target_form", "source_form", F.concat_ws(",", "target_kinds").alias("target_kinds"), F.concat_ws(",", "source_kinds").alias("source_kinds"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mixture_targets")
    weights = stage_weights(targets).unionByName(bundle_weights(table(spark, d, "source_allocation"), table(spark, d, "bundle_registry"), targets))
    return mix(sample_units(_samples(spark, d)), weights)


def p3_mixture(spark: SparkSession, d: str) -> DataFrame:
    """All mixtures in training order."""
    return sort_mixture(_mixture(spark, d)[0])


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(*_mixture(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return torn_groups(_samples(spark, d))


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(_samples(spark, d), table(spark, d, "split_targets"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the assignment reached."""
    r = split_report(p5_assignment(spark, d), table(spark, d, "split_targets"))
    return r.select("split", F.round("wanted_share", 6).alias("wanted_share"), "groups", "samples", F.round("reached_share", 6).alias("reached_share"))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """All groups and samples that were assigned, and the splits that miss their share by more than a hundredth of all samples."""
    r = split_report(p5_assignment(spark, d), table(spark, d, "split_targets"))
    off = F.count_if(F.abs(F.col("wanted_share") - F.col("reached_share")) > 0.01)
    return r.agg(F.sum("groups").alias("groups"), F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("splits"), off.alias("off_target"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlapping_pairs(_samples(spark, d))
    return pairs.select(F.least("eval_id", "train_id").alias("sample_id_a"), F.greatest("eval_id", "train_id").alias("sample_id_b")).distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    return overlap_counts(_samples(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaks found with up to one word changed in a passage, of which those with an unchanged passage remain."""
    found = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1)
    return found.where(F.col("longest_run") >= WINDOW).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with up to one word changed in a passage, and how much of the item they hold."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "language")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its languages and confidence; no language where it has no words."""
    per = document_languages(language_stretches(table(spark, d, "documents"), loose=True), min_words=1)
    rows = per.select(F.col("id").alias("doc_id"), "label", F.explode_outer("languages").alias("l"))
    return rows.select("doc_id", "label", F.col("l.language").alias("language"), F.col("l.words").alias("words"), F.round(F.coalesce("l.confidence", F.lit(0.0)), 4).alias("confidence"))


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches of one language in order, with their segments and text; one row without language where it has no words."""
    per = language_stretches(table(spark, d, "documents"), loose=True, with_text=True)
    rows = per.select(F.col("id").alias("doc_id"), "label", F.posexplode_outer("stretches").alias("number", "s"))
    return rows.select("doc_id", "label", "number", F.col("s.first").alias("first_segment"), F.col("s.last").alias("last_segment"), F.col("s.language").alias("language"), F.col("s.words").alias("words"), F.round(F.coalesce("s.confidence", F.lit(0.0)), 4).alias("confidence"), F.col("s.text").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_records, p2_found, p2_forms, p3_mixture, p3_shares, p5_found, p5_assignment, p5_shares, p5_check, p6_found, p6_counts, p7_ids, p8_found, p8_leaks, p9_found, p9_languages, p9_stretches)
}
