"""Splits that keep related records together (problem 5).

Rows that share a document key belong together, also through other rows. The keys of a row are its doc_id
and the document in its page_id (what stands before the last colon). Only rows that name two different
keys link anything, so the graph is built from the distinct pairs of different keys; all other keys are
groups of their own and never enter an iteration.

Components: alternating large-star and small-star steps over salted nodes (``operators.components``).

Assignment: component swap search. Components start from a hashed assignment. Those with at least ``big_share`` of all rows (a bounded
number) are one search of their own: they start from a greedy placement, largest first, and anneal against the wanted sizes and label counts.
The others fall by a hash of their group into blocks, each one task's group of rows in the order of their ids, so that a block's search
is the same whatever the batches, the shuffle width or the order of arrival. Blocks anneal in parallel against what the large ones left: components are
moved between splits or exchanged in order to reduce the deviation of sizes and label counts from the wanted shares, worse states
being accepted ever more rarely, and every search keeps its best state. ``split_report`` gives the shares reached.

Defined cases: null, empty and blank keys are none; a row without key is a group of its own for the
assignment (named by its id; without an id it is left out) and never a torn group; repeated rows count once in the torn report and once
per sample_id in sizes; an empty table gives empty results; splits that are not known stay unassigned.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import cut, ship_package

SPLITS = ("train", "validation", "test")


def split_name(column: Column) -> Column:
    """train, validation or test of any spelling; null for all else."""
    low = F.lower(F.regexp_replace(column, r"[\s\p{Z}]+", ""))
    return F.when(low.isin("val", "dev", "validation", "valid"), "validation").when(low.isin("train", "test"), low)


def document_keys(df: DataFrame) -> DataFrame:
    """``df`` with ``key_a`` (doc_id) and ``key_b`` (the document of page_id), each null where there is none."""
    blank = r"^[\s\p{Z}]*$"
    page = F.regexp_replace("page_id", r"(?s):[^:]*$", "")
    return df.withColumns(
        {
            "key_a": F.when(~F.col("doc_id").rlike(blank), F.col("doc_id")),
            "key_b": F.when(~F.col("page_id").rlike(blank) & ~page.rlike(blank), page),
        }
    )


def _grouped(rows: DataFrame, key: Column, *carried: str) -> DataFrame:
    """``rows`` (pre-aggregated, with key_a and key_b) with their ``group_id``."""
    keyed = rows.withColumn("key", key)
    links = rows.where("key_a <> key_b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    comps = connected_components(links)
    return keyed.join(comps, keyed["key"] == comps["node"], "left").select(F.coalesce("component", "key").alias("group_id"), *carried)


def torn_groups(samples: DataFrame) -> DataFrame:
    """``group_id`` of the groups whose rows stand in more than one split."""
    keyed = document_keys(samples.select("doc_id", "page_id", split_name(F.col("split_assignment")).alias("split")))
    slim = keyed.where("key_a is not null or key_b is not null").groupBy("key_a", "key_b", "split").agg(F.count(F.lit(1)).alias("n"))
    found = _grouped(cut(slim, "torn"), F.coalesce("key_a", "key_b"), "split")
    return found.where("split is not null").groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select("group_id")


def _hashed(hashes: list[float], shares: list[float]) -> list[int]:
    """A split for each hash in [0, 1), in the shares' proportions."""
    bounds = [sum(shares[: i + 1]) for i in range(len(shares))]
    return [next((i for i, b in enumerate(bounds) if h < b), len(shares) - 1) for h in hashes]


def _greedy(sizes: list[int], want: list[float]) -> list[int]:
    """A split for each component, in the order given: the one that lacks most."""
    left, at = want[:], []
    for n in sizes:
        at.append(max(range(len(left)), key=lambda i: (left[i], -i)))
        left[at[-1]] -= n
    return at


def _anneal(parts: list[dict], start: list[int], labels: int, seed: int, want: list[list[float]], sweeps: int) -> list[int]:
    """A split for each component, given its label counts and a first state; the best state seen."""
    rng = random.Random(seed)
    shares, at = want, start[:]
    have = [[0.0] * labels for _ in want]
    for counts, s in zip(parts, at, strict=True):
        for k, n in counts.items():
            have[s][k] += n
    floor = [[max(1.0, w) for w in row] for row in want]

    def cost(s: int, k: int, delta: float = 0.0) -> float:
        # the last label is the size of all, which counts as much as the others together
        d = (have[s][k] + delta - want[s][k]) ** 2 / floor[s][k]
        return d * (labels - 1 if k == labels - 1 else 1)

    def gain(counts: dict, a: int, b: int) -> float:
        return sum(cost(a, k, -n) - cost(a, k) + cost(b, k, n) - cost(b, k) for k, n in counts.items())

    def move(i: int, b: int) -> None:
        for k, n in parts[i].items():
            have[at[i]][k] -= n
            have[b][k] += n
        at[i] = b

    value, least, best = 0.0, 0.0, at[:]
    steps = sweeps * len(parts)
    heat0 = max(1.0, sum(cost(s, k) for s in range(len(shares)) for k in range(labels)) / max(1, len(parts)))
    for step in range(steps):
        heat = heat0 * math.exp(-6.0 * step / max(1, steps))
        i = rng.randrange(len(parts))
        if rng.random() < 0.7:
            b = rng.randrange(len(shares))
            if b == at[i]:
                continue
            d = gain(parts[i], at[i], b)
            if d <= 0 or rng.random() < math.exp(-d / heat):
                move(i, b)
                value += d
        else:
            j = rng.randrange(len(parts))
            a, b = at[i], at[j]
            if a == b:
                continue
            d = gain(parts[i], a, b)
            move(i, b)
            d += gain(parts[j], b, a)
            move(j, a)
            if d <= 0 or rng.random() < math.exp(-d / heat):
                value += d
            else:
                move(j, b)
                move(i, a)
        if value < least - 1e-9:
            least, best = value, at[:]
    return best


def assign_splits(samples: DataFrame, targets: DataFrame, *, label: str = "data_class", seed: int = 17, block_components: int = 4000, big_share: float = 0.001, sweeps: int = 12) -> DataFrame:
    """``group_id, n_samples, split``: one split for each group, in about the shares of ``targets``.

    On the driver: the targets, the label totals (the labels' number is checked) and the at most
    1 / ``big_share`` largest groups.
    """
    spark = samples.sparkSession
    ship_package(spark)
    keyed = document_keys(samples.select("sample_id", "doc_id", "page_id", F.coalesce(F.col(label), F.lit("")).alias("label")))
    slim = keyed.distinct().groupBy("key_a", "key_b", F.when(F.coalesce("key_a", "key_b").isNull(), F.col("sample_id")).alias("lone"), "label").agg(F.count_distinct("sample_id").alias("n"))
    slim = slim.where(F.coalesce("key_a", "key_b", "lone").isNotNull())
    found = _grouped(cut(slim, "split"), F.coalesce("key_a", "key_b", "lone"), "label", "n")
    per_label = found.groupBy("group_id", "label").agg(F.sum("n").alias("n"))
    groups = cut(per_label.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"), F.sum("n").alias("n_samples")), "groups")
    wanted = {r["split_name"]: float(r["share"] or 0) for r in targets.where("split_name is not null").collect()}
    names = [s for s in SPLITS if s in wanted] + sorted(set(wanted) - set(SPLITS))
    whole = sum(wanted.values()) or 1.0
    shares = [wanted[s] / whole for s in names]
    totals = {r["label"]: r["n"] for r in per_label.groupBy("label").agg(F.sum("n").alias("n")).limit(10_001).collect()}
    if len(totals) > 10_000:
        raise ValueError(f"{label} has more than 10,000 values; give a coarser label")
    labels = sorted(totals)
    width, size = len(labels) + 1, sum(totals.values())
    index = {x: i for i, x in enumerate(labels)}
    want = [[s * totals[x] for x in labels] + [s * size] for s in shares]

    least = max(2, big_share * size)
    big_rows = sorted(groups.where(F.col("n_samples") >= least).collect(), key=lambda r: (-r["n_samples"], r["group_id"])) if names else []
    big_parts = [{index[k]: n for k, n in r["counts"].items()} | {width - 1: r["n_samples"]} for r in big_rows]
    placed_at = _anneal(big_parts, _greedy([r["n_samples"] for r in big_rows], [w[-1] for w in want]), width, seed, want, sweeps) if big_parts else []
    fixed = [[0.0] * width for _ in names]
    for counts, s in zip(big_parts, placed_at, strict=True):
        for k, n in counts.items():
            fixed[s][k] += n
    small = groups.where(F.col("n_samples") < least)
    blocks = max(1, math.ceil(small.count() / block_components))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("group_id")
        counts, ns, hashes = (t.column(c).to_pylist() for c in ("counts", "n_samples", "unit"))
        parts = [{index[e["key"]]: e["value"] for e in c} | {width - 1: n} for c, n in zip(counts, ns, strict=True)]
        rest = max(1e-9, size - sum(f[-1] for f in fixed))
        quota = [[max(0.0, w - f) * sum(ns) / rest for w, f in zip(want[i], fixed[i], strict=True)] for i in range(len(names))]
        scale = sum(q[-1] for q in quota) or 1.0
        at = _anneal(parts, _hashed(hashes, [q[-1] / scale for q in quota]), width, seed, quota, sweeps)
        return pa.table({"group_id": t.column("group_id"), "n_samples": t.column("n_samples"), "split": pa.array([names[a] for a in at], pa.string())})

    if not names:
        return groups.select("group_id", "n_samples", F.lit(None).cast("string").alias("split"))
    placed = spark.createDataFrame([(r["group_id"], r["n_samples"], names[s]) for r, s in zip(big_rows, placed_at, strict=True)], "group_id string, n_samples bigint, split string")
    unit = (F.pmod(F.xxhash64("group_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("unit")
    block = F.pmod(F.xxhash64("group_id", F.lit(seed + 1)), F.lit(blocks)).alias("block")
    annealed = small.select("group_id", F.map_entries("counts").alias("counts"), "n_samples", unit, block).groupBy("block").applyInArrow(run, "group_id string, n_samples bigint, split string")
    return placed.unionByName(annealed)


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``split, wanted_share, groups, samples, reached_share``: what ``assign_splits`` reached."""
    whole = Window.partitionBy()
    wanted = targets.where("split_name is not null").groupBy(F.col("split_name").alias("split")).agg(F.max(F.coalesce("share", F.lit(0.0))).alias("share"))
    got = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_samples").alias("samples"))
    rows = wanted.join(got, "split", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("groups", "samples")})
    total, shares = F.nullif(F.sum("samples").over(whole), F.lit(0)), F.nullif(F.sum("share").over(whole), F.lit(0.0))
    return rows.select("split", (F.col("share") / shares).alias("wanted_share"), "groups", "samples", F.coalesce(F.col("samples") / total, F.lit(0.0)).alias("reached_share"))
