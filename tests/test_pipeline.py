"""Families on literal rows, and a whole build."""

import pytest

from scriptorium.plans import build as Q
from scriptorium.plans import pipeline
from scriptorium.shared import table
from scriptorium.sources import families as S
from scriptorium.sources.config import StageConfig


def one(rows, family):
    return S.FAMILIES[family](rows, "src", "b").first()


def test_families(spark):
    f = one(spark.createDataFrame([("", "\\frac{a}{b}")], "latex string, label string"), "formula")
    assert f["canonical_target"] == "$$\n\\frac{a}{b}\n$$" and f["target_type"] == "latex_formula"
    r = one(spark.createDataFrame([(0, "u1", [(2, [10, 20, 30, 40])])], "id int, uid string, annotations array<struct<category_id:int,bbox:array<int>>>"), "layout")
    assert r["canonical_target"] == "## Layout Regions\n- category_2: x=10, y=20, w=30, h=40" and r["doc_id"] == "u1" and r["sample_id"] == "src-u1"
    w = one(spark.createDataFrame([({"company": "ACME"}, ["ACME", "TOTAL", "12.00"], [[0, 0, 10, 10], [0, 20, 20, 30], [25, 20, 40, 30]])], "entities map<string,string>, words array<string>, bboxes array<array<int>>"), "receipt_words")
    assert w["canonical_target"] == "## Receipt Fields\n\n- company: ACME\n\n## Receipt OCR\n\nACME\nTOTAL 12.00"
    t = one(spark.createDataFrame([("f", [[(list("ab"),), (["c"],), (["1"],), (["2"],)]], 2)], "filename string, cells array<array<struct<tokens:array<string>>>>, cols int"), "table")
    assert "| ab | c |" in t["canonical_target"]
    assert one(spark.createDataFrame([(["Total", "x"], [3, 0])], "words array<string>, ner_tags array<int>"), "form")["canonical_target"] == "## Form Fields\n- question: Total"
    assert one(spark.createDataFrame([("put down",)], "text string"), "text_line")["canonical_target"] == "put down"
    assert S.FAMILIES["formula"](spark.createDataFrame([(None,), (" ",)], "latex string"), "s", "b").count() == 0
    S.register_source("mine", "text_line")
    assert S.samples_of(spark.createDataFrame([("x",)], "text string"), "mine", "b").first()["target_type"] == "text_line"
    assert S.samples_of(spark.createDataFrame([(1,)], "k int"), "unknown", "b").first()["canonical_target"] == '{"k": 1}'


def test_build(spark, data, tmp_path):
    columns = [c for c in table(spark, data, "canonical_samples").columns if c not in ("sample_id", "built_at", "loaded_at")]
    samples = Q.once(spark, data, *columns).withColumn("source_id", Q._sid())
    pairs = Q._bundle_sources(spark, data)
    result = pipeline.build(spark, StageConfig(stage="t", output_root=str(tmp_path)), samples, pairs, shards=True)
    want = {r["target_bundle"]: r["sample_count"] for r in Q.bundle_fanout_stats(spark, data).collect()}
    assert {r["bundle_id"]: r["sample_count"] for r in result.ledger.collect()} == want
    assert spark.read.format("shardtar").load(result.shard_path).count() == sum(want.values())
    assert spark.read.parquet(result.manifest_path).where("canonical_target is not null and canonical_target_hash <> sha2(canonical_target, 256)").count() == 0


def test_run_records_and_resume(spark, tmp_path, data):
    import json

    from scriptorium.plans import build as sources
    from scriptorium.plans import pipeline
    from scriptorium.shared import table
    from scriptorium.sources.config import StageConfig
    from scriptorium.sources.runs import Run, bundle_root, failure_manifest, quoted, serve_command

    run = Run(spark, "demo", str(tmp_path))
    run.manifest({"a": 1})
    run.heartbeat("running", rows=3.0)
    run.event("started", "build", "demo")
    run.event("ended", "build", "demo", {"n": 1})
    run.log("first \n")
    assert [json.loads(x)["event_type"] for x in (tmp_path / "demo/events.ndjson").read_text().splitlines()] == ["started", "ended"]
    assert (tmp_path / "demo/console.log").read_text().endswith("Z first\n") and json.loads((tmp_path / "demo/heartbeat.json").read_text())["latest_metrics"] == {"rows": 3.0}
    assert run.layout()["stop_flag"].endswith("demo/control/STOP") and not run.flag("STOP")
    assert bundle_root("b", {"b": "/x"}) == "/x" and bundle_root("b", target="hf://r/") == "hf://r/b"
    for bad in (lambda: bundle_root("b"), lambda: failure_manifest("")):
        with pytest.raises(RuntimeError):
            bad()
    assert quoted(serve_command("/my model")).startswith("vllm serve '/my model' --host")

    config = StageConfig(stage="s", output_root=str(tmp_path))
    names = [c for c in table(spark, data, "canonical_samples").columns if c not in ("sample_id", "built_at", "loaded_at")]
    samples = sources.once(spark, data, *names).withColumn("source_id", sources._sid())
    pairs = sources._bundle_sources(spark, data)
    some = sorted(r[0] for r in pairs.select("bundle_id").distinct().collect())
    pipeline.build(spark, config, samples, pairs.where(pairs["bundle_id"] == some[0]))
    whole = pipeline.build(spark, config, samples, pairs, resume=True)
    fresh = pipeline.build(spark, StageConfig(stage="t", output_root=str(tmp_path)), samples, pairs)
    assert sorted(map(tuple, whole.ledger.collect())) == sorted(map(tuple, fresh.ledger.collect()))
    (tmp_path / "s/control").mkdir()
    (tmp_path / "s/control/STOP").touch()
    with pytest.raises(pipeline.Stopped):
        pipeline.build(spark, config, samples, pairs)


def test_registered_sources(spark):
    from scriptorium.sources.families import KNOWN_SOURCES, SOURCES, samples_of

    assert len(KNOWN_SOURCES) == 25 and set(KNOWN_SOURCES) <= set(SOURCES)
    members = spark.createDataFrame([("a", 0, "img/x.jpg", b"i"), ("a", 1, "gt/val/x.txt", b"two  words")], "archive string, pos int, member string, content binary")
    got = samples_of(members, "read_2016", "b").first()
    assert (got["sample_id"], got["canonical_target"], got["split_assignment"]) == ("read_2016-x", "two words", "validation")
