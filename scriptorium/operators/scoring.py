"""Evaluation and selection: metric cards, aggregates, scorecards, rewards, variants."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P50, P95 = "p50_latency_ms_per_page", "p95_latency_ms_per_page"

# The metrics behind the six failure slices.
FAILURE_SLICES = {
    "formulas": ("latex_exact_match",), "merged_cell_tables": ("table_teds",), "handwriting": ("handwriting_score",), "rotation": ("rotation_score",),
    "graphics": ("wild_page_score",), "document_assembly": ("document_overall", "normalized_edit_similarity"),
}


def metric_cards(samples: DataFrame, computed: dict[str, Column], native: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One map of metrics per sample; native metrics of a sample take the place of computed ones of that name."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in computed.items()])
    if native:
        own = F.coalesce(F.map_entries(native), F.array().cast("array<struct<key:string,value:double>>"))
        names = F.transform(own, lambda e: e["key"])
        entries = F.concat(F.filter(entries, lambda e: ~F.array_contains(names, e["key"])), own)
    return samples.select(*(keep or []), F.map_from_entries(entries).alias("metrics"))


def aggregate_metrics(cards: DataFrame, by: list[str], *, exact: bool = True) -> DataFrame:
    """Long form of the aggregates: the largest p95, the median p50, the mean of all else, each over the cards that have it; and pages per second.

    The exact median keeps a group's different values while it aggregates; for groups of too many, ``exact=False`` takes a bounded sketch.
    """
    long = cards.select(*by, F.explode("metrics").alias("metric", "value")).where("value is not null")
    value = F.when(F.col("metric") == P95, F.max("value")).when(F.col("metric") == P50, F.median("value") if exact else F.percentile_approx("value", 0.5, 10_000)).otherwise(F.avg("value"))
    got = long.groupBy(*by, "metric").agg(value.alias("value"))
    speed = got.where(F.col("metric") == P50).select(*by, F.lit("pages_per_second").alias("metric"), (1000.0 / F.greatest("value", F.lit(1e-8))).alias("value"))
    return got.unionByName(speed)


def latency_card(cards: DataFrame, by: list[str]) -> DataFrame:
    """Mean of p50 and largest p95 over all cards, a missing value counting as 0."""
    return cards.groupBy(*by).agg(
        F.avg(F.coalesce(F.col("metrics")[P50], F.lit(0.0))).alias("p50"), F.max(F.coalesce(F.col("metrics")[P95], F.lit(0.0))).alias("p95"), F.count(F.lit(1)).cast("double").alias("sample_count")
    )


def scorecard(aggregates: DataFrame, by: list[str], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per group; each column is the first of its metrics that there is, or 0."""
    names = sorted({m for ms in columns.values() for m in ms})
    wide = aggregates.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    return wide.select(*by, *[F.coalesce(*[F.col(m) for m in ms], F.lit(0.0)).alias(c) for c, ms in columns.items()])


def failure_slices(aggregates: DataFrame, by: list[str]) -> DataFrame:
    wide = scorecard(aggregates, by, FAILURE_SLICES)
    return wide.unpivot(by, list(FAILURE_SLICES), "slice", "score")


def block_f1(predicted: Column, reference: Column) -> Column:
    """F1 over the sets of block types; both empty give 1, a missing side 0."""
    p, r = F.array_distinct(predicted), F.array_distinct(reference)
    tp = F.size(F.array_intersect(p, r))
    f1 = 2.0 * tp / (F.size(p) + F.size(r))
    return F.when(predicted.isNull() | reference.isNull(), 0.0).when((F.size(p) == 0) & (F.size(r) == 0), 1.0).when(tp == 0, 0.0).otherwise(f1)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Masked weighted mean; weights summing to less than one count as one."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def reward_terms(rows: DataFrame, *, by: list[str], signal: str, value: str, weights: DataFrame, clip: float = 2.5, least: int = 4, floor: float = 0.02, normalize: bool = True) -> DataFrame:
    """Per group and signal the clipped mean times its weight; groups large enough are standardised first, and uninformative means vanish."""
    g = [*by, signal]
    stats = rows.groupBy(*g).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    scaled = F.when(F.lit(normalize) & (F.col("n") >= least), (F.col(value) - F.col("mu")) / F.greatest("sd", F.lit(1e-6))).otherwise(F.col(value))
    clipped = F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))
    means = rows.join(stats, g).groupBy(*g).agg(F.avg(clipped).alias("mean")).where(F.abs("mean") >= floor)
    return means.join(weights, signal).select(*g, (F.col("mean") * F.col("weight")).alias("term"))


def next_step_loss(rows: DataFrame, *, key: str, order: str, value: str, steps: int) -> DataFrame:
    """Each value with the targets 1..steps ahead in its sequence."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.select("*", *[F.lead(value, s).over(w).alias(f"ahead_{s}") for s in range(1, steps + 1)])


# --- variants -------------------------------------------------------------

EPS = 1e-8


def variant_scores(variants: DataFrame, reference: dict[str, float], goal: dict[str, float]) -> DataFrame:
    """Retention, gains, whether the floors hold, and the score (null where they do not)."""
    floor = F.lit(EPS)
    retention = F.col("overall_score") / max(reference["overall_score"], EPS)
    latency = F.lit(max(reference["latency_ms"], EPS)) / F.greatest("latency_ms", floor)
    memory = F.lit(max(reference["peak_memory_gb"], EPS)) / F.greatest("peak_memory_gb", floor)
    passes = (
        (F.col("overall_score") >= goal["quality_floor"])
        & (F.col("markdown_validity") >= goal["markdown_validity_floor"])
        & (F.col("latex_validity") >= goal["latex_validity_floor"])
        & (F.col("peak_memory_gb") <= goal["max_memory_gb"])
        & (1.0 - retention <= goal["max_relative_quality_drop"])
        & (latency - 1.0 >= goal["min_latency_gain"])
    )
    return variants.withColumns({"quality_retention": retention, "latency_gain": latency, "memory_gain": memory, "passes_floors": passes}).withColumn(
        "score", F.when(F.col("passes_floors"), 0.55 * F.col("quality_retention") + 0.3 * F.col("latency_gain") + 0.15 * F.col("memory_gain"))
    )


def _skyline(t: pa.Table) -> pa.Table:
    """The triples (high, low, low) that no other one dominates: a sweep from the best high value down over a staircase of the two low ones."""
    from bisect import bisect_left, bisect_right

    high, a, b = (t.column(i).to_pylist() for i in range(3))
    lows, least, keep = [], [], []
    for k in sorted(range(len(high)), key=lambda k: (-high[k], a[k], b[k])):
        at = bisect_right(lows, a[k])
        if at and least[at - 1] <= b[k]:
            continue
        keep.append(k)
        at = end = bisect_left(lows, a[k])
        while end < len(lows) and least[end] >= b[k]:
            end += 1
        lows[at:end], least[at:end] = [a[k]], [b[k]]
    return t.take(pa.array(keep, pa.int64()))


def pareto_frontier(rows: DataFrame, best_high: str, best_low: tuple[str, str], id_column: str, fan_in: int = 16) -> DataFrame:
    """Rows that no other row dominates (one high, two low criteria); equal rows stay, and so do rows that lack a criterion (null or no number).

    A row that is dominated within any part of the rows is dominated: every part keeps its own frontier, parts are brought together ``fan_in`` to
    one, and so on to the last. What moves is frontiers, not rows; the rows then meet the last one by equality.
    """
    names = [best_high, *best_low]
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    schema = ",".join(f"{c} double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = pa.table({c: pa.array([], pa.float64()) for c in names})
        for b in batches:
            best = _skyline(pa.concat_tables([best, pa.Table.from_batches([b])]).combine_chunks())
        yield from best.to_batches()

    def reduced(x: DataFrame) -> DataFrame:
        return x.mapInArrow(run, schema)

    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    best = reduced(values.distinct())
    while parts > 1:
        parts = -(-parts // fan_in)
        best = reduced(best.repartition(parts))
    best = reduced(best.coalesce(1)).select(*[F.col(c).alias(f"_{c}") for c in names])
    equal = [F.col(c).cast("double") == F.col(f"_{c}") for c in names]
    lacking = reduce(lambda x, y: x | y, (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in names))
    return rows.where(~lacking).join(best, equal, "left_semi").unionByName(rows.where(lacking))


def first_names(rows: DataFrame, by: list[str], name: str, amount: str, n: int = 5) -> DataFrame:
    """Per group the sum and the first n different names in order; no task holds more than n names of a group."""
    sums = rows.groupBy(*by).agg(F.sum(amount).alias("total"))
    w = Window.partitionBy(*by).orderBy(name)
    few = rows.where(F.col(name).isNotNull()).select(*by, name).distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    names = few.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))
    return sums.join(names, by, "left").withColumn("names", F.coalesce("names", F.lit("")))
