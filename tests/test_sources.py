"""Source formats and sinks on files written by the tests."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import archives as A
from scriptorium.sources import registry as R
from scriptorium.sources import sinks as K
from scriptorium.sources import tables as T
from scriptorium.sources.config import StageConfig
from scriptorium.streaming import events as E


def make_tar(path, files, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_registry_lists_and_flags(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source_id,probe_policy,probe_method,probe_url,remote_fetchable,build_surface,notes\na,automated,HEAD,u,yes,s,\nb,manual,,,conditional,s,n\n")
    assert [(r["source_id"], r["remote_fetchable"]) for r in R.read_registry(spark, "source-endpoints", str(tmp_path / "e.csv")).collect()] == [("a", True), ("b", False)]
    (tmp_path / "b.csv").write_text("bundle_id,stage,bundle_class,primary_sources,data_class_mix,persistent_store,target_status,notes\nb1,s,c,x||y|,m,p,t,n\nb2,s,c,,m,p,t,n\n")
    assert [r["primary_sources"] for r in R.read_registry(spark, "bundle-registry", str(tmp_path / "b.csv")).collect()] == [["x", "y"], []]
    assert R.read_quotas(spark, str(tmp_path / "none.csv")).count() == 0


def test_manual_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_manual(spark, str(tmp_path))
    (tmp_path / "samples.jsonl").write_text(json.dumps({"sample_id": "s", "canonical_target": "t", "doc_id": " ", "metadata": {"w": "1"}}) + "\n\n" + json.dumps({"sample_id": "no"}) + "\n")
    got = T.read_manual(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["doc_id"] == "s" and got[0]["split_assignment"] == "train" and got[0]["slice_tags"] == [] and got[0]["metadata"] == {"w": "1"}


def test_failures_and_package_lists(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text(json.dumps({"source_sample_id": "x", "source_bundle_id": "b"}) + "\n\n")
    row = T.read_failures(spark, str(tmp_path / "f.jsonl")).first()
    assert row["failure_type"] == "model_failure" and row["difficulty_tier"] == "hard"
    (tmp_path / "1.csv").write_text("a,b,Cit1,PMC1,c,d,CC\na,b,Head,Key,c,d,L\nshort,row\na,b,Cit2,PMC2,c,d,CC\n")
    (tmp_path / "2.csv").write_text("a,b,Again,PMC1,c,d,CC\n")
    got = T.read_package_list(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()
    assert {(r["package_id"], r["citation"]) for r in got} == {("PMC1", "Cit1"), ("PMC2", "Cit2")}


def test_harvest(spark, tmp_path):
    rec = "<record><header><identifier>i{0}</identifier><datestamp>2024-0{0}-01</datestamp></header><metadata><arXiv><id>{1}</id><title>T</title></arXiv></metadata></record>"
    (tmp_path / "p.xml").write_text("<OAI>" + rec.format(1, "a") + rec.format(2, "") + rec.format(3, "c") + "</OAI>")
    assert [r["id"] for r in T.read_harvest(spark, str(tmp_path / "p.xml"), since="2024-02-01").collect()] == ["c"]


def test_splits_in_order(spark, tmp_path):
    for name in ("test", "odd", "train"):
        spark.createDataFrame([(name, 1)], "x string, y int").write.parquet(str(tmp_path / name))
    rows = T.read_splits(spark, {n: str(tmp_path / n) for n in ("test", "odd", "train")}, keep=["x", "zz"])
    assert rows.columns == ["x", "split", "split_rank"]
    assert [(r["x"], r["split"]) for r in rows.orderBy("split_rank").collect()] == [("train", "train"), ("test", "test"), ("odd", "train")]
    assert T.preferred_config(["b", "a"]) == "a" and T.preferred_config(["default", "a"]) == "default" and T.preferred_config([]) is None


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("images/s1.png", b"x")
        z.writestr("m.jsonl", json.dumps({"img": "images/s1.png", "latex": "a"}) + "\n" + json.dumps({"img": " "}))
        z.writestr("t.tsv", "file_name\tlabel\ti.png\n")
    make_tar(tmp_path / "b.tgz", {"d/p.JPG": b"j", "d/p.xml": b"<x/>"}, "w:gz")
    (tmp_path / "c.tar").write_bytes((tmp_path / "b.tgz").read_bytes()[:20])
    members = A.read_members(spark, str(tmp_path / "*.*"))
    assert {r["member"] for r in members.collect()} == {"images/s1.png", "m.jsonl", "t.tsv", "d/p.JPG", "d/p.xml"}
    assert [(r["image"], r["label"]) for r in A.manifest_pairs(members).collect()] == [("images/s1.png", "a")]
    assert {r["path"].rpartition("/")[2]: r["valid"] for r in A.valid_archives(spark, str(tmp_path / "*.*")).collect()} == {"a.zip": True, "b.tgz": True, "c.tar": False}


def test_coco(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}, {"id": 2, "file_name": "b"}], "annotations": [{"id": 2, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}, {"id": 1, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 7, "name": "table"}]}))
    got = {r["image_id"]: [x["label"] for x in r["regions"]] for r in A.coco_regions(spark, str(tmp_path / "c.json")).collect()}
    assert got == {1: ["category_9", "table"], 2: []}


def test_shards_round_trip(spark, tmp_path):
    A.register(spark)
    rows = spark.createDataFrame([(f"s.{i}", "text" * 50, "page_markdown", "b") for i in range(20)], "sample_id string, canonical_target string, target_type string, bundle_id string")
    A.shard_rows(rows.coalesce(1)).write.format("shardtar").option("target_bytes", 1000).mode("append").save(str(tmp_path / "s"))
    shards = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert shards[0] == "shard-000000.tar" and len(shards) > 3
    back = spark.read.format("shardtar").load(str(tmp_path / "s"))
    assert sorted((r["sample_id"], r["target"], json.loads(r["sample_json"])["bundle_id"]) for r in back.collect()) == sorted((f"s.{i}", "text" * 50, "b") for i in range(20))
    with pytest.raises(Exception):
        spark.read.format("shardtar").load(str(tmp_path / "none")).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "b1"), ("s2", "b2")], "sample_id string, bundle_id string")
    K.write_manifest(rows, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").iterdir() if p.is_dir()} == {"bundle=b1", "bundle=b2"}
    assert K.publish(rows, str(tmp_path / "p"))["rows"] == 2
    K.write_json(spark, str(tmp_path / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'


def test_config():
    c = StageConfig.from_mapping({"profile": "p", "sources": ["a"], "odd": 1}, {"shard_target_mb": 64})
    assert c.profile == "p" and c.shard_target_mb == 64 and c.extra == {"odd": 1} and c.limit("a", 7) == 7


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"), (F.col("id") % 3).alias("user_id"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    E.run_available(E.hourly_counts(stream, lateness="1 second"), out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("window_start", "event_type", "events", "total").collect()}
    want = {tuple(r) for r in E.hourly_counts(rows).collect()}
    assert got <= want and len(want) - len(got) <= 2  # the last hours are still open
    assert E.user_sessions(rows).agg(F.sum("events")).first()[0] == 200
    E.append_events(spark.createDataFrame([("x",)], "event_type string").select(F.current_timestamp().alias("ts"), "event_type", F.lit("p").alias("phase"), F.lit("s").alias("stage"), F.lit("{}").alias("payload")), str(tmp_path / "log"))
    assert E.read_event_log(spark, str(tmp_path / "log")).count() == 1
    assert not E.stop_requested(spark, str(tmp_path))
