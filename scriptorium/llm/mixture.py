"""Mixing sources to target weights (problem 3).

Every mixture names components (data classes of a stage, sources of a bundle) with wanted shares of its total
size, and how often a record may be used. A mixture is as large as the pool of its components (times ``passes``). A component that
cannot fill its share of it within its uses falls short: it gives every record as often as allowed, the others still give what is wanted of
them, and the report shows the shares reached. With ``fit`` the mixture shrinks instead until every component can fill its share.
Filled shares differ from the demand by less than one record per component; a wanted component without any record gives nothing.

Method: time-varying curriculum. A component's weight is a function of training time, w(t) = share * (1 + tilt * (2t - 1)),
t from 0 to 1: components of higher rank come rather late, those of lower rank rather early, all weights sum to 1 at any
time and integrate to the shares of the mixture. A component's records stand in hashed order on a line of their sizes, once for each
use. A record at the place x of a line of demand D is due when the integral of the weight schedule reaches
x / D; this is inverted in closed form. Records are then range-sorted by their position.

The running sum along a component's line is taken in three steps, over the 256 ranges of the hash, the 256 ranges within each, and the records
within those: a component with a third of 10^10 records has 50,000 of them in a task's window. Nothing is collected to the driver.

Defined cases: rows without id, component or positive size take no part; a sample delivered twice is one record (of differing deliveries the
smallest as a whole); null, zero or negative weights want nothing; weights that do not sum to 100 are scaled; a null or non-positive
number of uses counts as one; of several quotas of a bundle and source the latest holds; empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .form import normalise_column

DATA_CLASSES = ("weak_aux", "trusted_aux", "multilingual", "synthetic_exact", "exact_pair")
"""From the class that should come early to the one that should come late."""
_ROUND = 0.4142135
"""Positions are whole numbers; places stand at simple fractions, which no rounding at this point splits by the last bit of a sum."""
_TRIM = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _source(column: str) -> Column:
    return F.lower(F.regexp_replace(column, _TRIM, ""))


def stage_weights(targets: DataFrame) -> DataFrame:
    """``mix_id, pool, component, weight, uses, rank`` of each stage; the pool of all stages is the whole table."""
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_pct").cast("double").alias("weight"), F.lit(i / (len(DATA_CLASSES) - 1)).alias("rank")) for i, c in enumerate(DATA_CLASSES)])
    return targets.select(F.concat(F.lit("stage:"), "stage_id").alias("mix_id"), F.lit("*").alias("pool"), F.explode(cells).alias("c"), F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(1)).alias("uses")).select(
        "mix_id", "pool", "c.component", "c.weight", "uses", "c.rank"
    )


def bundle_weights(allocation: DataFrame, bundles: DataFrame, targets: DataFrame) -> DataFrame:
    """The same of each bundle: its sources by their quotas; uses come from the bundle's stage as last recorded."""
    clean = normalise_column(allocation.select("bundle_id", "source_id", "target_samples", "recorded_at", "record_id"), "source_id", "source", "_k")
    quota = (
        clean.withColumn("source", _source("source"))
        .where("source <> '' and bundle_id is not null")
        .groupBy("bundle_id", "source")
        .agg(F.max_by("target_samples", F.struct("recorded_at", "record_id")).alias("weight"))
    )
    stage = bundles.groupBy("bundle_id").agg(F.max_by("stage", F.struct("recorded_at", "record_id")).alias("stage_id"))
    uses = stage.join(targets.select("stage_id", "max_repeat"), "stage_id", "left").select("bundle_id", "max_repeat")
    return quota.join(uses, "bundle_id", "left").select(
        F.concat(F.lit("bundle:"), "bundle_id").alias("mix_id"),
        F.col("bundle_id").alias("pool"),
        F.col("source").alias("component"),
        F.col("weight").cast("double").alias("weight"),
        F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(1)).alias("uses"),
        F.lit(0.5).alias("rank"),
    )


def sample_units(samples: DataFrame) -> DataFrame:
    """``pool, component, sample_id, size``: each sample once in the pool of the stages and once in that of its bundle."""
    kept = samples.select("sample_id", "source_id", "bundle_id", "data_class", F.col("target_char_count").cast("bigint").alias("size")).where("sample_id is not null and size > 0")
    one = normalise_column(kept, "source_id", "source", "_k").withColumn("source", _source("source"))
    one = one.groupBy("sample_id").agg(F.min(F.struct("data_class", "bundle_id", "source", "size")).alias("r")).select("sample_id", "r.*")
    pools = F.array(F.struct(F.lit("*").alias("pool"), F.col("data_class").alias("component")), F.struct(F.col("bundle_id").alias("pool"), F.col("source").alias("component")))
    return one.select("sample_id", "size", F.explode(pools).alias("p")).select("p.pool", "p.component", "sample_id", "size").where("pool is not null and component is not null")


def demands(weights: DataFrame, available: DataFrame, *, passes: float = 1.0, ramp: float = 0.8, fit: bool = False) -> DataFrame:
    """``weights`` with what each component has, its share of the mixture, its demand, the mixture's total and its tilt."""
    want = weights.where("weight > 0").groupBy("mix_id", "pool", "component").agg(F.sum("weight").alias("weight"), F.max("uses").alias("uses"), F.max("rank").alias("rank"))
    mix = Window.partitionBy("mix_id")
    have = want.join(available, ["pool", "component"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    able = F.col("available") > 0
    shared = have.withColumns(
        {
            "wanted_share": F.col("weight") / F.sum("weight").over(mix),
            "share": F.coalesce(F.when(able, F.col("weight")) / F.sum(F.when(able, F.col("weight"))).over(mix), F.lit(0.0)),
            "aim": F.sum("available").over(mix) * F.lit(passes),
        }
    )
    if fit:
        shared = shared.withColumn("aim", F.coalesce(F.least("aim", F.min(F.when(able, F.col("uses") * F.col("available") / F.col("share"))).over(mix)), F.lit(0.0)))
    filled = shared.withColumn("demand", F.least(F.col("share") * F.col("aim"), (F.col("uses") * F.col("available")).cast("double"))).withColumn("total", F.sum("demand").over(mix))
    mean = F.sum(F.col("demand") * F.col("rank")).over(mix) / F.nullif(F.col("total"), F.lit(0.0))
    return filled.withColumn("tilt", F.lit(ramp) * (F.col("rank") - mean)).drop("aim")


def mix(units: DataFrame, weights: DataFrame, *, passes: float = 1.0, ramp: float = 0.8, fit: bool = False, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The unsorted mixture (``mix_id, component, sample_id, use, size, position``) and the demands it fills."""
    hashed = units.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string"))))
    placed = cut(hashed.withColumns({"hi": F.substring("h", 1, 2), "lo": F.substring("h", 3, 2)}), "units")
    line = ["pool", "component"]
    fine = placed.groupBy(*line, "hi", "lo").agg(F.sum("size").alias("in_lo"))
    coarse = fine.groupBy(*line, "hi").agg(F.sum("in_lo").alias("in_hi"))
    available = coarse.groupBy(*line).agg(F.sum("in_hi").alias("available"))
    starts = coarse.withColumn("start", F.sum("in_hi").over(Window.partitionBy(*line).orderBy("hi")) - F.col("in_hi")).drop("in_hi")
    inner = fine.withColumn("inner", F.sum("in_lo").over(Window.partitionBy(*line, "hi").orderBy("lo")) - F.col("in_lo")).drop("in_lo")
    offsets = inner.join(starts, [*line, "hi"]).select(*line, "hi", "lo", (F.col("start") + F.col("inner")).alias("offset"))
    need = cut(demands(weights, available, passes=passes, ramp=ramp, fit=fit), "need")
    run = placed.withColumn("before", F.sum("size").over(Window.partitionBy(*line, "hi", "lo").orderBy("h", "sample_id")) - F.col("size"))
    lined = run.join(offsets, [*line, "hi", "lo"]).select(*line, "sample_id", "size", (F.col("offset") + F.col("before")).alias("place"))
    used = lined.join(need.where("demand > 0").select("mix_id", *line, "uses", "available", "demand", "total", "tilt"), line)
    copies = F.least(F.col("uses").cast("bigint"), F.ceil((F.col("demand") - F.col("place") - F.lit(1e-6) * F.col("demand") / F.col("total")) / F.col("available")))
    each = used.withColumn("copies", copies).where("copies > 0").withColumn("use", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    u = F.least(F.lit(1.0), (F.col("place") + (F.col("use") - 1) * F.col("available")) / F.col("demand"))
    r = F.col("tilt")
    t = F.when(F.abs(r) < 1e-9, u).otherwise((r - 1 + F.sqrt((1 - r) * (1 - r) + 4 * r * u)) / (2 * r))
    out = each.select("mix_id", "component", "sample_id", F.col("use").cast("int").alias("use"), "size", F.floor(t * F.col("total") + F.lit(_ROUND)).alias("position"))
    return out, need


def sort_mixture(mixture: DataFrame) -> DataFrame:
    """The mixture in training order, range-partitioned by mixture and position."""
    return mixture.orderBy("mix_id", "position", "component", "sample_id", "use")


def mixture_shares(mixture: DataFrame, need: DataFrame) -> DataFrame:
    """Per mixture and component: wanted and actual share, characters, records and the most uses of one record."""
    got = mixture.groupBy("mix_id", "component").agg(F.sum("size").alias("chars"), F.count_if(F.col("use") == 1).alias("records"), F.max("use").alias("most_uses"))
    full = need.select("mix_id", "component", "wanted_share", "available", "uses").join(got, ["mix_id", "component"], "left")
    total = F.sum("chars").over(Window.partitionBy("mix_id"))
    return full.select(
        "mix_id", "component", F.round("wanted_share", 6).alias("wanted_share"), F.round(F.coalesce(F.col("chars") / total, F.lit(0.0)), 6).alias("actual_share"),
        "available", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.col("uses").alias("uses_allowed"),
    )
