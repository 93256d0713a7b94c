"""Orphan references against a nested loop, with the cases that are easily wrong."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scriptorium.operators.orphans import orphan_report, orphans, source_references

T0 = datetime(2024, 1, 1)
REFS = "record_id bigint, source_id string, recorded_at timestamp, _at string"
PARENTS = "source_id string, registered_at timestamp, retired_at timestamp"


def run(spark, refs, parents, hot=2):
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    got = orphans(r, p, key="source_id", at="recorded_at", spread=F.col("record_id"), valid_from="registered_at", valid_to="retired_at", hot=hot)
    return sorted((x["record_id"], x["orphan_cause"]) for x in got.collect())


def brute(refs, parents):
    out = []
    for i, key, at, _ in refs:
        own = [(a, b) for k, a, b in parents if k == key and a is not None and (b is None or b > a)]
        if key is None or at is not None and any(a <= at and (b is None or at < b) for a, b in own):
            continue
        out.append((i, "missing" if not own else "undated" if at is None else "deleted" if any(a <= at for a, _ in own) else "late"))
    return sorted(out)


def test_against_nested_loop(spark):
    rng = random.Random(5)
    day = lambda: T0 + timedelta(days=rng.randrange(20))
    parents = [(rng.choice("abcd"), day(), rng.choice([None, day()])) for _ in range(14)] + [(None, T0, None), ("e", None, None)]
    refs = [(i, rng.choice(["a", "b", "c", "d", "e", "x", None]), rng.choice([day(), day(), None]), "clash") for i in range(120)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_bounds_are_half_open(spark):
    parents = [("a", T0, T0 + timedelta(days=1)), ("a", T0 + timedelta(days=2), None)]
    refs = [(k, "a", T0 + timedelta(days=d), None) for k, d in enumerate((-1, 0, 1, 2))]
    assert run(spark, refs, parents) == [(0, "late"), (2, "deleted")]


def test_repeated_rows_count_and_empty_tables(spark):
    assert run(spark, [(1, "x", T0, None)] * 3, []) == [(1, "missing")] * 3
    assert run(spark, [], [("a", T0, None)]) == []


def test_references_are_cleaned(spark):
    b = spark.createDataFrame([(1, " A | a||b ", T0), (2, None, T0)], "record_id bigint, primary_sources string, recorded_at timestamp")
    s = spark.createDataFrame([(3, " C ", T0), (4, "  ", T0), (5, None, T0)], "record_id bigint, source_id string, recorded_at timestamp")
    got = source_references(b, s, s.where("false"))
    assert sorted((r["record_id"], r["source_id"]) for r in got.collect()) == [(1, "a"), (1, "b"), (3, "c")]
    found = got.withColumns({"period": F.lit("2024-01"), "orphan_cause": F.lit("late")})
    assert {(r["table_name"], r["orphans"]) for r in orphan_report(found).collect()} == {("bundle_registry", 2), ("source_allocation", 1)}
