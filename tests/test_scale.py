"""Operators that keep hot keys apart, against plain Python; planning and leakage on literal rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import build as B
from scriptorium.operators import curation as C
from scriptorium.operators import layout as L
from scriptorium.operators import planning as N
from scriptorium.operators import scoring as S
from scriptorium.operators.skew import met_with_one


def test_hot_keys_meet_once(spark):
    rows = [("hot", i) for i in range(40)] + [("cold", 40), ("none", 41), (None, 42)]
    many = spark.createDataFrame(rows, "k string, v int")
    one = many.groupBy("k").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).where("k <> 'none'")
    for hot in (3, 1000):
        got = sorted((r["k"], r["v"], r["least"]) for r in met_with_one(many, one, ["k"], spread=F.col("v"), count="n", hot=hot).collect())
        assert got == sorted([("hot", i, 0) for i in range(40)] + [("cold", 40, 40)])


def test_first_by_hash(spark):
    rows = [(f"s{i}", "ab"[i % 5 == 0]) for i in range(300)]
    got = C.first_by_hash(spark.createDataFrame(rows, "id string, c string"), by="c", id_column="id", quota=F.lit(20))
    want = {(c, i, k) for c in "ab" for k, i in enumerate(sorted((i for i, x in rows if x == c), key=lambda i: hashlib.sha256(i.encode()).hexdigest())[:20], 1)}
    assert {(r["c"], r["id"], r["_k"]) for r in got.collect()} == want
    assert C.first_by_hash(spark.createDataFrame([], "id string, c string"), by="c", id_column="id", quota=F.lit(20)).count() == 0


def test_numbers_by_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), i) for i in range(200)]
    rng.shuffle(rows)
    got = B.number_rows(spark.createDataFrame(rows, "k string, i int").repartition(5), ["i"], "n", ["k"]).collect()
    for key in ("a", "b", None, ""):
        assert [r["i"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["n"])] == sorted(i for k, i in rows if k == key)
        assert sorted(r["n"] for r in got if r["k"] == key) == list(range(sum(k == key for k, _ in rows)))


def most_rows(spark, since=0):
    """The most rows that an operator of any query put out, and the number of queries so far; ``since``: the number of those before."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(since, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(v.get().replace(",", "")))
    return most, runs.size()


def test_statistics_of_a_fan_out(spark):
    rng = random.Random(11)
    rows = [(f"s{i:03}", rng.choice("aaabcd"), rng.choice([None, *"uvwxyz", f"own{i}"]), rng.choice([None, "p"]), rng.choice([None, 1, 5])) for i in range(400)]
    rows += [("t", None, "u", "p", 1), ("t", "d", "u", None, None), ("t", "d", "v", "p", 2)]
    pairs = [(f"b{i}", s, rng.choice([None, 1, 2, 7, 8, 9, 60, 10_000])) for i in range(40) for s in "abcd" if rng.random() < 0.6] + [(None, "a", 3), (None, "b", None), ("empty", "z", None), ("none", "a", 0)]
    want = {}
    for b in {p[0] for p in pairs}:
        kept = [r for x, s, q in pairs if x == b for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[0], r[2]))[:q]]
        sizes = [r[4] for r in kept if r[4] is not None]
        if kept:
            want[b] = (len(kept), len({r[2] for r in kept} - {None}), sum(r[3] is not None for r in kept), sum(sizes) if sizes else None)
    samples = spark.createDataFrame(rows, "sample_id string, source_id string, doc_id string, page_id string, target_char_count int").repartition(5)
    sources = spark.createDataFrame(pairs, "bundle_id string, source_id string, quota int")
    for band in (4, B.BAND):
        got = {r[0]: tuple(r)[1:] for r in B.fan_out_stats(samples, sources, ["sample_id"], band=band).collect()}
        assert got == want
    assert B.fan_out_stats(samples.where("false"), sources, ["sample_id"]).count() == 0


@pytest.mark.parametrize("query", ["bundle_fanout_stats", "run_totals"])
def test_fan_out_is_not_made(spark, tmp_path, query):
    from scriptorium.plans.build import QUERIES

    n, bundles = 2000, 200
    spark.range(n).selectExpr("'s' || id AS sample_id", "'a' AS source_id", "'d' || id % 50 AS doc_id", "CAST(NULL AS string) AS page_id", "2 AS target_char_count").write.parquet(f"{tmp_path}/canonical_samples.parquet")
    spark.range(bundles).selectExpr("id AS record_id", "'b' || id AS bundle_id", "'a' AS primary_sources", "timestamp_seconds(id) AS recorded_at").write.parquet(f"{tmp_path}/bundle_registry.parquet")
    spark.range(bundles).selectExpr("'b' || id AS bundle_id", "'a' AS source_id", "CAST(id + 1 AS int) AS target_samples").write.parquet(f"{tmp_path}/source_allocation.parquet")
    before = most_rows(spark)[1]
    got = QUERIES[query](spark, str(tmp_path)).collect()
    made = bundles * (bundles + 1) // 2
    assert sum(r["samples" if query == "run_totals" else "sample_count"] for r in got) == made
    assert n <= most_rows(spark, before)[0] < 3 * n


def test_totals_make_no_pairs_of_documents_and_bundles(spark, tmp_path):
    from scriptorium.plans.build import QUERIES

    # every document stands in two sources, at ranks between other quotas; all bundles have both
    n, bundles = 600, 200
    spark.range(2 * n).selectExpr("'s' || lpad(id, 5, '0') AS sample_id", "IF(id % 2 = 0, 'a', 'b') AS source_id", "'d' || id div 2 AS doc_id", "IF(id % 3 = 0, 'p:1', NULL) AS page_id", "2 AS target_char_count").write.parquet(f"{tmp_path}/canonical_samples.parquet")
    spark.range(bundles).selectExpr("id AS record_id", "'b' || id AS bundle_id", "'a|b' AS primary_sources", "timestamp_seconds(id) AS recorded_at").write.parquet(f"{tmp_path}/bundle_registry.parquet")
    spark.range(2 * bundles).selectExpr("'b' || id div 2 AS bundle_id", "IF(id % 2 = 0, 'a', 'b') AS source_id", f"CAST({n} - id div 2 AS int) AS target_samples").write.parquet(f"{tmp_path}/source_allocation.parquet")
    before = most_rows(spark)[1]
    got = QUERIES["run_totals"](spark, str(tmp_path)).collect()
    kept = [i for b in range(bundles) for i in range(2 * (n - b))]
    assert [tuple(r) for r in got] == [(len(kept), sum(i % 3 == 0 for i in kept), 2 * len(kept), bundles)]
    assert 2 * n <= most_rows(spark, before)[0] < 6 * n


def test_tails_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    members = [f"a/{''.join(rng.choices('xyé', k=rng.randint(1, 9)))}" for _ in range(200)] + [None]
    names = sorted({m[-k:] for m in members if m for k in (1, 3, 4, len(m))}) + ["zz", "long" * 30, None]
    want = {n: min(m for m in members if m and m.endswith(n)) for n in names if n and any(m and m.endswith(n) for m in members)}
    for few, plan in ((0, ["SortMergeJoin"]), (100, ["BroadcastHashJoin", "SortMergeJoin"]), (10**6, ["BroadcastHashJoin"])):
        monkeypatch.setattr(L, "FEW_CHARS", few, raising=False)
        found = L.suffix_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(m,) for m in members], "member string"))
        assert dict(map(tuple, found.collect())) == want
        assert [j for j in ("BroadcastHashJoin", "SortMergeJoin") if j in found._jdf.queryExecution().executedPlan().toString()] == plan
    assert L.suffix_match(spark.createDataFrame([], "name string"), spark.createDataFrame([("m",)], "member string")).count() == 0


def test_shards_of_a_large_key(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARDS_PER_TASK", 2)
    rows = spark.createDataFrame([("big", i, 3) for i in range(60)] + [("small", 0, 99), ("small", 1, None)], "bundle string, i int, size int")
    got = B.shard_numbers(rows, key="bundle", order=["i"], size="size", target=10).collect()
    sizes: dict = {}
    for r in got:
        sizes[r["bundle"], r["shard"]] = sizes.get((r["bundle"], r["shard"]), 0) + (r["size"] or 0)
    assert len(got) == 62 and all(n <= 10 for (k, _), n in sizes.items() if k == "big") and len({s // B.SHARD_STEP for k, s in sizes if k == "big"}) > 1


def test_frontier_with_missing_values(spark):
    rng = random.Random(7)
    rows = [(i, *(rng.choice([1.0, 2.0, 3.0, 4.0, None]) for _ in range(3))) for i in range(150)] + [(150, float("nan"), 1.0, 1.0)]
    whole = [r for r in rows if None not in r and r[1] == r[1]]
    beaten = {r[0] for r in whole if any(o[1] >= r[1] and o[2] <= r[2] and o[3] <= r[3] and o[1:] != r[1:] for o in whole)}
    got = S.pareto_frontier(spark.createDataFrame(rows, "i int, q double, l double, m double").repartition(6), "q", ("l", "m"), "i", fan_in=2)
    assert {r["i"] for r in got.collect()} == {r[0] for r in rows} - beaten
    assert S.pareto_frontier(spark.createDataFrame([], "i int, q double, l double, m double"), "q", ("l", "m"), "i").count() == 0


def test_first_names(spark):
    rows = spark.createDataFrame([("g", n, 1) for n in "fedcba"] + [("g", "a", 1), ("h", None, 2)], "g string, name string, n int")
    assert {tuple(r) for r in S.first_names(rows, ["g"], "name", "n", 3).collect()} == {("g", 7, "a,b,c"), ("h", 2, "")}


def test_profiles_and_quotas(spark):
    profiles = spark.createDataFrame([("p", ["b"])], "profile_id string, bundles array<string>")
    assert N.one_profile(profiles, "p").count() == 1
    with pytest.raises(ValueError):
        N.one_profile(profiles, "q")
    quotas = spark.createDataFrame([("b", "s", 2), ("c", "s", 1), ("b", "t", 5), ("b", "u", None)], "bundle_id string, source_id string, quota int")
    written = spark.createDataFrame([("b", "s", 2), ("c", "s", 4), ("b", "t", 4)], "bundle_id string, source_id string, n int")
    assert [r[0] for r in N.full_sources(written, quotas).collect()] == ["s"]
    assert N.full_sources(written.where("false"), quotas.where("false")).count() == 0
    names = spark.createDataFrame([("llmcompressor_x",), ("torchao",), ("odd",), (None,)], "m string")
    assert [r[0] for r in names.select(N.backend_family(F.col("m"))).collect()] == ["llmcompressor", "torchao", "custom", None]
    params = spark.createDataFrame([("writer.norm.w",), ("planner.bias",), ("planner.w",), ("x.LayerNorm",)], "m string")
    assert [r[0] for r in params.select(N.without_decay(F.col("m"))).collect()] == [True, True, False, True]


def test_leakage_checks(spark):
    long = " ".join(f"w{i}" for i in range(30))
    held = [("h1", "D", "# Tide table\nnorth"), ("h2", None, long), ("h3", None, None), ("h4", None, "--")]
    own = [("a", "D", "anything else"), ("b", "E", "#  tide TABLE\nsouth"), ("c", "F", long.upper() + "!"), ("d", "G", long + " and more"), ("e", "G", "quite another text"), ("f", None, None), ("g", None, "--"), ("h", "H", "")]
    schema = "id string, doc string, t string"
    got = {r["id"]: (r["checks"], r["action"]) for r in C.leakage_checks(spark.createDataFrame(own, schema), spark.createDataFrame(held, schema), id_column="id", family="doc", text="t").collect()}
    assert got == {
        "a": (["identifier"], "exclude"), "b": (["title"], "hold_for_review"), "c": (["target", "near_target"], "exclude"), "d": (["near_target"], "hold_for_review"), "e": (["family"], "keep_but_demote"),
        "f": ([], "keep"), "g": ([], "keep"), "h": ([], "keep"),
    }
    empty = spark.createDataFrame([], schema)
    assert C.leakage_checks(empty, empty, id_column="id", family="doc", text="t").count() == 0
