"""Scans of tabular and line formats into sample rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, first_filled, split_of_path
from ..schemas import FAILURES, MANUAL, SAMPLE_DEFAULTS

SPLIT_ORDER = ("train", "validation", "test")


def pruned(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep that are there; all of them if none is. The scan reads no others."""
    have = [c for c in keep if c in rows.columns]
    return rows.select(*have) if have else rows


def read_splits(spark: SparkSession, paths: dict[str, str], *, keep: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Parquet files of several splits in one frame, with ``split`` (unknown names are train) and its rank in visiting order."""
    order = sorted(paths, key=lambda s: (SPLIT_ORDER.index(s) if s in SPLIT_ORDER else len(SPLIT_ORDER), s))
    parts = []
    for rank, name in enumerate(order):
        rows = spark.read.parquet(paths[name])
        rows = pruned(rows, keep) if keep else rows
        parts.append(rows.withColumns({"split": F.lit(name if name in SPLIT_ORDER else "train"), "split_rank": F.lit(rank)}))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows if limit is None else rows.orderBy("split_rank").limit(limit)


def preferred_config(names: list[str]) -> str | None:
    return "default" if "default" in names else min(names, default=None)


def with_file_split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("split", split_of_path(F.col("_metadata.file_path")))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Manual rows with the defaults of their fields; blank counts as missing, and the document defaults to the sample."""
    made = rows.withColumns({c: F.coalesce(filled(F.col(c)), F.lit(v)) for c, v in SAMPLE_DEFAULTS.items()})
    return made.withColumns({"doc_id": first_filled(F.col("doc_id"), F.col("sample_id")), **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("slice_tags", "asset_paths")}})


def read_manual(spark: SparkSession, root: str) -> DataFrame:
    """The manual manifest of a folder: samples.jsonl, else samples.parquet, else an error. Rows without id or target are rejected by the reader."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def there(name: str) -> bool:
        return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"))

    if there("samples.jsonl"):
        rows = spark.read.schema(MANUAL).json(f"{root}/samples.jsonl")
    elif there("samples.parquet"):
        found = spark.read.parquet(f"{root}/samples.parquet")
        rows = spark.createDataFrame([], MANUAL).unionByName(pruned(found, spark.createDataFrame([], MANUAL).columns), allowMissingColumns=True)
    else:
        raise FileNotFoundError(f"{root} has neither samples.jsonl nor samples.parquet")
    return with_defaults(rows.where("sample_id is not null and canonical_target is not null"))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """The failure manifest (JSON lines); blank lines are none."""
    rows = spark.read.schema(FAILURES).json(path).where("source_sample_id is not null")
    return rows.withColumns({"failure_type": F.coalesce(filled(F.col("failure_type")), F.lit("model_failure")), "difficulty_tier": F.coalesce(filled(F.col("difficulty_tier")), F.lit("hard"))})


def read_package_list(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Package lists without header (path, citation, id, ..., licence): rows of seven cells with an id, each id once, first file and line first."""
    parts = []
    for i, path in enumerate(paths):
        raw = spark.read.option("quote", '"').schema(", ".join(f"c{k} string" for k in range(7))).csv(path)
        parts.append(raw.select(F.col("c3").alias("package_id"), F.col("c2").alias("citation"), F.col("c6").alias("license"), F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line")))
    rows = reduce(DataFrame.unionByName, parts).where("license is not null and package_id like 'PMC%'")
    first = rows.groupBy("package_id").agg(F.min_by(F.struct("citation", "license", "file", "line"), F.struct("file", "line")).alias("r")).select("package_id", "r.*")
    return first if limit is None else first.orderBy("file", "line").limit(limit)


def read_harvest(spark: SparkSession, path: str, *, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Landed pages of a metadata harvest (XML): records with an id; the limit counts these only."""
    schema = "header struct<identifier:string,datestamp:string>, metadata struct<arXiv:struct<id:string,title:string,abstract:string,license:string>>"
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).schema(schema).load(path)
    found = rows.select(F.col("metadata.arXiv.*"), F.col("header.datestamp").alias("datestamp")).where(filled(F.col("id")).isNotNull())
    found = found if since is None else found.where(F.col("datestamp") >= since)
    return found if limit is None else found.limit(limit)


def quota_by_group(rows: DataFrame, group: str, order: str, total: int, groups: int) -> DataFrame:
    """At most ceil(total / groups) rows of every group, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= -(-total // groups)).drop("_k")


def sample_rows(rows: DataFrame, *, source_id: str, bundle_id: str, target: Column, target_type: str, ids: list[Column], tags: list[str] | None = None) -> DataFrame:
    """Rows of any family as samples: the id is the first filled of several columns, zero counting as empty, else the row's number."""
    number = F.monotonically_increasing_id().cast("string")
    doc = F.coalesce(*[F.when(~c.cast("string").isin("0", "0.0", "false"), filled(c.cast("string"))) for c in ids], number)
    made = rows.select(doc.alias("doc_id"), target.alias("canonical_target"), *([F.col("split").alias("split_assignment")] if "split" in rows.columns else [F.lit("train").alias("split_assignment")]))
    return made.where("canonical_target is not null and canonical_target <> ''").select(
        F.concat_ws("-", F.lit(source_id), "doc_id").alias("sample_id"), F.lit(source_id).alias("source_id"), F.lit(bundle_id).alias("bundle_id"), "doc_id", "canonical_target",
        F.lit(target_type).alias("target_type"), "split_assignment", F.array(*map(F.lit, tags or [])).cast("array<string>").alias("slice_tags"),
    )
