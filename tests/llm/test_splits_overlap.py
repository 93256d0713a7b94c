"""Splits by component (problem 5) and overlaps between splits (problem 6)."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm.overlap import Terms, dot_products, listed_terms, near_classes, overlap_counts, overlap_members, overlapping_pairs, squared_weights, word_distance
from scriptorium.llm.records import record_tuple, words_of
from scriptorium.llm.splits import assign_splits, split_name, split_report, torn_groups

SAMPLE = "sample_id string, doc_id string, page_id string, split_assignment string, data_class string, source_id string, canonical_target string"


def test_split_names(spark):
    values = [" Train", "VAL", "dev ", "validation", "te st", "other", "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, s string").orderBy("i").select(split_name(__import__("pyspark").sql.functions.col("s"))).collect()]
    assert got == ["train", "validation", "validation", "validation", "test", None, None, None]


def make(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        doc = rng.choice([None, "hot:1", f"d:{rng.randrange(60)}", f"s{i}", " "])
        page = rng.choice([None, f"d:{rng.randrange(60)}:{rng.randrange(9)}", "hot:1:2", "nocolon", ":3"])
        rows.append((f"s{i}", doc, page, rng.choice(["train", "Train ", "val", "test", None]), rng.choice("ab"), None, None))
    return rows + rows[:20]


def groups_of(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    keys = []
    for r in rows:
        ks = [k for k in (r[1], r[2] and r[2].rsplit(":", 1)[0]) if k and k.strip()]
        for k in ks:
            find(k)
        if len(ks) == 2:
            x, y = sorted((find(ks[0]), find(ks[1])))
            root[y] = x
        keys.append(ks)
    return [find(ks[0]) if ks else None for ks in keys]


def test_torn_groups(spark):
    rows = make(4)
    name = {"train": "t", "Train ": "t", "val": "v", "test": "e"}
    splits = defaultdict(set)
    for r, g in zip(rows, groups_of(rows), strict=True):
        if g and r[3]:
            splits[g].add(name[r[3]])
    df = spark.createDataFrame(rows, SAMPLE)
    assert {r["group_id"] for r in torn_groups(df).collect()} == {g for g, s in splits.items() if len(s) > 1}
    assert torn_groups(df.where("false")).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", f"d{int(rng.random() ** 2 * 400)}", None, None, rng.choice("abc"), None, None) for i in range(4000)]
    df = spark.createDataFrame(rows, SAMPLE)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    got = assign_splits(df, targets).collect()
    assert len({r["group_id"] for r in got}) == len(got) == len({r[1] for r in rows}) and sum(r["n_samples"] for r in got) == 4000
    share = defaultdict(int)
    for r in got:
        share[r["split"]] += r["n_samples"] / 4000
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01
    of = {r["group_id"]: r["split"] for r in got}
    for label in "abc":
        own = [of[r[1]] for r in rows if r[4] == label]
        assert abs(own.count("train") / len(own) - 0.8) < 0.05
    assert assign_splits(df.where("false"), targets).count() == 0
    assert {r["split"] for r in assign_splits(df, targets.where("false")).collect()} == {None}


def test_assignment_does_not_depend_on_batches(spark):
    rng = random.Random(9)
    rows = [(f"s{i}", f"d{int(rng.random() ** 2 * 900)}", None, None, rng.choice("abc"), None, None) for i in range(5000)]
    df = spark.createDataFrame(rows, SAMPLE)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    seen = []
    for batch, width, parts in ((10_000, 4, 1), (50, 3, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
        seen.append(sorted(map(tuple, assign_splits(df.repartition(parts), targets, block_components=100).collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
    report = {r["split"]: r for r in split_report(spark.createDataFrame(seen[0], "group_id string, n_samples bigint, split string"), targets).collect()}
    assert sum(r["samples"] for r in report.values()) == 5000 and all(abs(r["reached_share"] - r["wanted_share"]) < 0.01 for r in report.values())
    assert {r["samples"] for r in split_report(assign_splits(df.where("false"), targets), targets).collect()} == {0}


def test_large_groups_are_searched_with_their_labels(spark):
    rows = [(f"s{g}-{i}", f"d{g}", None, None, "ab"[g % 2], None, None) for g in range(12) for i in range(50)]
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, share double")
    got = {r["group_id"]: r["split"] for r in assign_splits(spark.createDataFrame(rows, SAMPLE), targets).collect()}
    for label in (0, 1):
        assert sum(got[f"d{g}"] == "train" for g in range(12) if g % 2 == label) == 3


def test_word_distance():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(15))] for _ in "ab")
        for most in (0, 2, 20):
            assert min(word_distance(a, b, most), most + 1) == min(plain(a, b), most + 1)


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = f"new{rng.randrange(99)}"
        elif kind == 1 and len(w) > 1:
            w.pop(i)
        else:
            w.insert(i, rng.choice(words))
    return w


def test_pairs_against_all_pairs(spark):
    rng = random.Random(8)
    common = ["the", "of", "sensor", "housing", "run", "in", "with", "small", "offset"]
    rows = []
    for k in range(60):
        n = rng.choice([8, 19, 20, 21, 33, 60])
        base = [rng.choice(common) if rng.random() < 0.85 else f"name{rng.randrange(300)}" for _ in range(n)]
        for j in range(rng.randrange(1, 4)):
            t = " ".join(edited(rng, base, rng.choice([0, 1, 2, int(0.15 * n), int(0.15 * n) + 1, int(0.2 * n) + 1])))
            rows.append((f"s{k}-{j}", None, None, rng.choice(["train", "train", "val", "test", None]), "a", f" Src{k % 3}", t.title() if j % 2 else t + " ."))
    rows += [("f1", None, None, "train", "a", None, "- a: 1\n- b: 2"), ("f2", None, None, "test", "a", None, '{"b": "2", "a": "1"}'), ("n1", None, None, "train", "a", None, None), ("n2", None, None, "test", "a", None, ""), ("n3", None, None, "test", "a", None, "--")]
    rows += rows[:15]
    df = spark.createDataFrame(rows, SAMPLE)
    kept = {r[0]: (r[3], words_of(r[6]), record_tuple(r[6])) for r in rows if r[3] and r[6] and words_of(r[6])}
    want = set()
    for a, (sa, wa, ra) in kept.items():
        for b, (sb, wb, rb) in kept.items():
            if sa == "train" or sb != "train":
                continue
            longest = max(len(wa), len(wb))
            if ra == rb or (min(len(wa), len(wb)) >= 20 and word_distance(wa, wb, longest) <= int(0.15 * longest + 1e-9)):
                want.add((a, b))
    pairs = overlapping_pairs(df)
    got = [(r["eval_id"], r["train_id"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("f2", "f1") in want
    counts = overlap_counts(df).collect()
    same = {(a, b) for a, b in want if kept[a][2] == kept[b][2]}
    assert sum(r["same_record_pairs"] for r in counts) == len(same) and sum(r["leaked"] for r in counts) == len({b for b, _ in want})
    assert sum(r["pairs"] for r in counts) == len(want) and sum(r["samples"] for r in counts) == len({r[0] for r in rows if r[3] in ("val", "test")})
    assert overlapping_pairs(df.where("false")).count() == 0


def test_listed_terms_cover_every_loss():
    budget = lambda n: int(0.15 * n + 1e-9)
    for n in range(20, 2000):
        # the longer text's budget d at each gap g loses up to 2 d - g of the shorter one's terms, 2 d of its own
        most = max(2 * budget(n + g) - g for g in range(budget(2 * n) + 1) if g <= budget(n + g))
        assert listed_terms(np.array([n]), 0.15)[0] > most


@pytest.mark.parametrize("n", [26, 33, 39, 40, 47])
def test_recall_with_skewed_rarity(spark, n):
    """Templates whose edited words are the rarest, at lengths where the budget steps up, among texts that share the rest."""
    rng = random.Random(n)
    base = [f"w{i}" for i in range(n + 1)]
    d = int(0.15 * (n + 1) + 1e-9)
    short = base[:]
    for i in rng.sample(range(n), d - 1):
        short[i] = f"edit{i}"
    short.pop(rng.randrange(n))
    rows = [("t", None, None, "train", "a", None, " ".join(base)), ("e", None, None, "val", "a", None, " ".join(short))]
    rows += [(f"o{k}", None, None, "val", "a", None, " ".join(base + [f"own{k}x{i}" for i in range(20)])) for k in range(4)]
    rows += [(f"r{k}", None, None, rng.choice(["train", "val"]), "a", None, " ".join(edited(rng, base[: rng.randrange(20, n + 1)], rng.randrange(d + 2)))) for k in range(60)]
    of = {r[0]: (r[3], r[6].split()) for r in rows}
    want = {(a, b) for a, (sa, wa) in of.items() for b, (sb, wb) in of.items() if sa == "val" and sb == "train" and min(len(wa), len(wb)) >= 20 and word_distance(wa, wb, len(wa)) <= int(0.15 * max(len(wa), len(wb)) + 1e-9)}
    df = spark.createDataFrame(rows, SAMPLE)
    assert ("e", "t") in want
    members = overlap_members(df)
    assert {(r["eval_id"], r["train_id"]) for r in overlapping_pairs(df, hot=3).collect()} == want
    assert {tuple(r) for r in near_classes(members, hot=2, buckets=16).collect()} == {tuple(r) for r in near_classes(members).collect()}


def test_dot_products_against_counters():
    rng = random.Random(5)
    left, right = ([" ".join(rng.choice("abc") for _ in range(rng.randrange(2, 30))) for _ in range(50)] for _ in "ab")
    rarity = np.arange(64, dtype=np.uint32)
    a, b = Terms(left), Terms(right)
    dot, wa, wb = dot_products(a, b, rarity)
    for i in range(50):
        ca, cb = (Counter(x.hash[x.text == i].tolist()) for x in (a, b))
        want = sum(float(squared_weights(np.float64(rarity[h % 64]))) * min(k, cb[h]) for h, k in ca.items())
        assert abs(dot[i] - want) < 1e-9


def test_pairs_where_the_budget_steps_up(spark):
    rng = random.Random(26)
    rows, want = [], set()
    for k in range(120):
        n = rng.choice([26, 33])
        short = [f"a{k}x{i}" for i in range(n)]
        d = int(0.15 * (n + 1) + 1e-9)
        at = sorted(rng.sample(range(1, n - 1, 2), d))
        long = [f"b{k}x{i}" if i in at[:-1] else w for i, w in enumerate(short)]
        long.insert(at[-1], f"c{k}")
        # the terms that the train text alone has are rarest and come first
        rows += [(f"t{k}", None, None, "train", "a", None, " ".join(short)), (f"e{k}", None, None, "test", "a", None, " ".join(long))]
        if word_distance(short, long, d) <= d:
            want.add((f"e{k}", f"t{k}"))
    assert len(want) == 120
    assert {(r["eval_id"], r["train_id"]) for r in overlapping_pairs(spark.createDataFrame(rows, SAMPLE)).collect()} == want
