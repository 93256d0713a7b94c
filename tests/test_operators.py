"""Core operators on small fixtures, most against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import build as B
from scriptorium.operators import curation as C
from scriptorium.operators import layout as L
from scriptorium.operators import scoring as S
from scriptorium.operators.components import connected_components
from scriptorium.operators.neardup import near_duplicate_classes


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(80)] + [("a", None), ("a", "a")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a string, b string"), hot=2).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    docs = []
    for t in texts:
        docs.append(t)
        for _ in range(rng.randrange(3)):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            docs.append(" ".join(w))
    docs += [texts[0].upper(), "", None, "too short", "Too, short!"]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {r["id"]: (r["class_id"], r["links"]) for r in near_duplicate_classes(rows).collect()}

    def sh(t):
        w = (t or "").lower().replace(",", " ").replace("!", " ").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = [sh(t) for t in docs]
    cls = list(range(len(docs)))
    near = {(a, b) for a, b in combinations(range(len(docs)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    for _ in docs:
        for a, b in near:
            cls[a] = cls[b] = min(cls[a], cls[b])
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(cls))
    for i in range(len(docs)):
        others = {sets[b if a == i else a] for a, b in near if i in (a, b)} - {sets[i]}
        assert got[i][1] == len(others)


def test_pareto_against_all_pairs(spark):
    rng = random.Random(1)
    v = [(i, float(rng.randrange(6)), float(rng.randrange(6)), float(rng.randrange(6))) for i in range(80)]
    got = {r["i"] for r in S.pareto_frontier(spark.createDataFrame(v, "i int, q double, l double, m double"), "q", ("l", "m"), "i").collect()}
    want = {a[0] for a in v if not any(b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3] and b[1:] != a[1:] for b in v)}
    assert got == want


def test_shards_restart_and_hold_large_rows(spark):
    rows = spark.createDataFrame([("b", i, s) for i, s in enumerate([4, 4, 4, 20, 1, 9, 1])] + [("c", 0, 99), ("c", 1, None)], "bundle string, i int, size int")
    got = B.shard_numbers(rows, key="bundle", order=["i"], size="size", target=10).orderBy("bundle", "i").collect()
    assert [r["shard"] for r in got] == [0, 0, 1, 2, 3, 3, 4, 0, 0] or [r["shard"] for r in got][:7] == [0, 0, 1, 2, 3, 3, 4]


def test_topk_ties_and_tags(spark):
    rows = spark.createDataFrame([("a", "x" * 300, ["formula"], "p"), ("b", "x" * 300, ["formula"], "p"), ("c", None, None, None), ("d", "$$", ["formula", "approved_exact"], None)], "sample_id string, canonical_target string, slice_tags array<string>, page_id string")
    top = B.approved_top(rows, 2).collect()
    assert [r["score"] for r in top] == [5, 5] and top[0]["sample_id"] == min("ab", key=lambda x: __import__("hashlib").sha256(x.encode()).hexdigest())
    assert {r["sample_id"]: r["slice_tags"] for r in B.approved_samples(rows, 4).collect()}["d"] == ["formula", "approved_exact"]


def test_expansion_and_packs(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = B.synthetic_expansion(rows, ["r1", "r2"], 5).orderBy("emission").collect()
    assert [(r["sample_id"], r["recipe"], r["emission"]) for r in got] == [("a", "r1", 0), ("b", "r1", 1), ("a", "r2", 2), ("b", "r2", 3), ("a", "r1", 4)]
    assert B.synthetic_expansion(rows.where("false"), ["r"], 5).count() == 0
    s = spark.createDataFrame([(f"s{i}", "x") for i in range(5)], "sample_id string, data_class string")
    packs = B.prompt_packs([(B.GENERAL, s, 2), (B.REPAIR, s, 9)], 4).collect()
    assert sorted((r["pack"], r["sample_id"], r["data_class"]) for r in packs) == [("general", "s0", "gold_exact"), ("general", "s1", "gold_exact"), ("repair", "s0", "x"), ("repair", "s1", "x")]


def test_text_lines_of_words(spark):
    words = "from_json('[{\"x0\":25,\"y0\":20,\"y1\":30,\"text\":\"12.00\"},{\"x0\":0,\"y0\":0,\"y1\":10,\"text\":\"ACME\"},{\"x0\":0,\"y0\":20,\"y1\":30,\"text\":\"TOTAL\"}]', 'array<struct<x0:double,y0:double,y1:double,text:string>>')"
    assert spark.range(1).select(L.text_lines(F.expr(words))).first()[0] == ["ACME", "TOTAL 12.00"]


def test_runs(spark):
    rows = spark.createDataFrame([("u", i, x, f"t{i}") for i, x in enumerate(["a", "a", None, None, "o", "a"])], "k string, i int, label string, t string")
    got = L.run_texts(rows, key="k", order=["i"], label="label", text="t", drop="o").collect()
    assert sorted((r["run"], r["text"]) for r in got) == [(1, "t0 t1"), (4, "t5")]
    assert [r["run"] for r in L.runs(rows, key="k", order=["i"], label="label").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]


def test_runs_in_chunks_are_the_same(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.choice("uv"), i, rng.choice(["a", "a", "b", None])) for i in range(120)], "k string, i int, label string")
    whole = {(r["k"], r["i"]): r["run"] for r in L.runs(rows, key="k", order=["i"], label="label").collect()}
    for n in (1, 7, 50):
        got = L.runs(rows, key="k", order=["i"], label="label", chunk=F.floor(F.col("i") / n))
        assert {(r["k"], r["i"]): r["run"] for r in got.collect()} == whole


def test_numbers_follow_the_order(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(rng.randrange(10), i) for i in range(300)], "a int, b int").repartition(5)
    got = B.number_rows(rows, ["a", "b"]).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(300)) and [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)
    assert B.number_rows(rows.where("false"), ["a"]).count() == 0


def test_quota_with_and_without_bound(spark):
    rows = spark.createDataFrame([(k, i, {"a": 3, "b": None, "c": 0}[k]) for k in "abc" for i in range(6)], "k string, i int, quota int")
    for most in (None, 3):
        got = sorted((r["k"], r["i"]) for r in B.within_quota(rows, ["k"], [F.col("i")], F.col("quota"), most).collect())
        assert got == [("a", 0), ("a", 1), ("a", 2)] + [("b", i) for i in range(6)]
    by_range = B.within_quota(rows.repartition(3), ["k"], [F.col("i")], F.col("quota"), hot=2)
    assert sorted((r["k"], r["i"]) for r in by_range.collect()) == [("a", 0), ("a", 1), ("a", 2)] + [("b", i) for i in range(6)]


def test_block_f1_and_metrics(spark):
    row = spark.range(1).select(S.block_f1(F.expr("array('a','a','b')"), F.expr("array('b','c')")).alias("f"), S.block_f1(F.expr("array()").cast("array<string>"), F.expr("array()").cast("array<string>")).alias("e"), S.block_f1(F.lit(None).cast("array<string>"), F.expr("array('a')")).alias("n")).first()
    assert (row["f"], row["e"], row["n"]) == (0.5, 1.0, 0.0)
    cards = S.metric_cards(spark.createDataFrame([("x", 1200.0, {"t": 0.93}), ("x", 1260.0, {})], "k string, v double, native map<string,double>"), {S.P50: F.col("v"), S.P95: F.col("v")}, "native", ["k"])
    a = {r["metric"]: r["value"] for r in S.aggregate_metrics(cards, ["k"]).collect()}
    assert a[S.P50] == 1230 and a[S.P95] == 1260 and a["t"] == 0.93 and abs(a["pages_per_second"] - 1000 / 1230) < 1e-9
    card = S.latency_card(cards, ["k"]).first()
    assert card["p50"] == 1230 and card["p95"] == 1260 and card["sample_count"] == 2


def test_variants(spark):
    goal = dict(quality_floor=0.93, markdown_validity_floor=0.9, latex_validity_floor=0.9, max_memory_gb=20.0, max_relative_quality_drop=0.015, min_latency_gain=0.15)
    rows = spark.createDataFrame([("fp8", 0.941, 930.0, 16.5, 1.0, 1.0), ("int4", 0.934, 760.0, 12.0, 1.0, 1.0), ("bad", 0.5, 1.0, 1.0, 1.0, 1.0)], "variant_id string, overall_score double, latency_ms double, peak_memory_gb double, markdown_validity double, latex_validity double")
    got = {r["variant_id"]: r["passes_floors"] for r in S.variant_scores(rows, dict(overall_score=0.945, latency_ms=1200.0, peak_memory_gb=22.0), goal).collect()}
    assert got == {"fp8": True, "int4": True, "bad": False}


def test_identity_and_gates(spark):
    row = spark.range(1).select(C.document_identity(F.lit("T"), F.lit("https://doi.org/10.1/X"), F.lit("u")).alias("a"), C.document_identity(F.lit("A  long, Title!"), F.lit(""), F.lit("u")).alias("b"), C.document_identity(F.lit("x"), F.lit(None).cast("string"), F.lit("http://www.A.org/p/?q")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("id:10.1/x", "title:a long title", "url:a.org/p")


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_anchor_draws_fill_exactly(spark, share):
    rows = spark.createDataFrame([(i, i < 3) for i in range(20)], "id int, a boolean")
    got = {r["side"]: r["n"] for r in C.anchor_draws(rows, anchor=F.col("a"), id_column="id", draws=50, anchor_share=share).groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert got == ({"anchor": 25, "primary": 25} if share else {"primary": 50})


def test_duplicates_of_all_scripts(spark):
    texts = ["Второй вариант", "Отчёт о доме", "второй  ВАРИАНТ!", "Café, figure 1", "Cafè, figure 1", "caf figure 1", "हिन्दी", "हन्दी", "--", " . ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [tuple(r) for r in C.exact_duplicates(df, C.word_key(F.col("text")), "doc_id").collect()] == [(0, 2)]
