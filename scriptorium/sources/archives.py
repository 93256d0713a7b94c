"""Archives: members of tar and zip files as rows, and the tar shard format as a data source of its own.

An archive is the unit of parallel reading (its members cannot be split), so many archives read in parallel, each streamed
member by member: a task opens its archives itself, on any file system, and holds a bounded batch of members, whatever the size of the archive.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..shared import ship_package

MEMBERS = "archive string, pos int, member string, content binary"
BATCH_BYTES = 16 << 20
_BROKEN = (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, pa.ArrowInvalid)
_TAR_NAMES = (".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tbz")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)


def members_of(name: str, source: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """The plain files of an archive, in order; a gzip file that is no tar is one file; a broken archive gives what can be read."""
    try:
        head = source.read(2)
        source.seek(0)
        if head == b"PK":
            with zipfile.ZipFile(source) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, z.read(i)
            return
        with tarfile.open(fileobj=source, mode="r:*") as t:
            for m in t:
                if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/"):
                    yield m.name, t.extractfile(m).read()
                t.members = []  # headers of a long archive do not pile up
    except _BROKEN:
        source.seek(0)
        if source.read(2) == b"\x1f\x8b":
            import gzip

            source.seek(0)
            try:
                yield name.rpartition("/")[2].removesuffix(".gz"), gzip.decompress(source.read())
            except (EOFError, OSError):
                return


def archive_paths(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files under a path, without their content, an archive to a task."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return names.repartition(max(1, min(10_000, names.count())))


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """One row per member of all archives under a path."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = file_system(name)
                held: list[tuple] = []
                size = 0
                with system.open_input_file(at) as source:
                    for pos, (member, data) in enumerate(members_of(name, source)):
                        held.append((name, pos, member, data))
                        size += len(data)
                        if size > BATCH_BYTES:
                            yield _batch(held)
                            held, size = [], 0
                if held:
                    yield _batch(held)

    return archive_paths(spark, path).mapInArrow(run, MEMBERS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "pos", "member", "content"])


def _opens(name: str) -> bool:
    system, at = file_system(name)
    if not system.get_file_info(at).size:
        return False
    with system.open_input_file(at) as source:
        try:
            if name.endswith(".zip"):
                zipfile.ZipFile(source).close()
            elif name.endswith(_TAR_NAMES):
                with tarfile.open(fileobj=source, mode="r:*") as t:
                    return all(True for _ in t)
        except _BROKEN:
            return False
    return True


def valid_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, valid``: whether a cached download is there, not empty and opens as what its name says."""
    ship_package(spark)

    @F.arrow_udf("boolean")
    def opens(names: pa.Array) -> pa.Array:
        return pa.array(map(_opens, names.to_pylist()), pa.bool_())

    return archive_paths(spark, path).select("path", opens("path").alias("valid"))


def _json(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def manifest_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``archive, image, label, id`` told by an archive's manifest members (JSON lines, JSON lists, CSV or TSV), keys under any of their usual names."""
    import csv

    def records(member: str, content: bytes) -> list[dict]:
        text = content.decode("utf-8", "replace")
        if member.endswith(".jsonl"):
            return [r for x in text.splitlines() if x.strip() and isinstance(r := _json(x), dict)]
        # any other manifest, a .json one as well, is read as a table of named columns
        return list(csv.DictReader(io.StringIO(text), delimiter="\t" if member.endswith(".tsv") else ","))

    def first(r: dict, *keys: str) -> str | None:
        return next((str(r[k]).strip() for k in keys if str(r.get(k) or "").strip()), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for a, m, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    out += [(a, first(r, "image", "image_path", "img", "file_name", "filename"), first(r, "label", "latex", "text", "formula", "target"), first(r, "id", "sample_id", "uid")) for r in records(m, c)]
                except (ValueError, csv.Error):
                    continue
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["archive", "image", "label", "id"])

    manifests = members.where(F.lower("member").rlike(r"\.(jsonl|json|csv|tsv)$") & ~F.contains(F.lower("member"), F.lit("readme")))
    return manifests.select("archive", "member", "content").mapInArrow(run, "archive string, image string, label string, id string").where("image is not null and label is not null")


def coco_regions(spark: SparkSession, path: str) -> DataFrame:
    """Images of COCO files with their annotations (label, box) in order; images without any keep an empty list."""
    schema = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    notes = doc.select(names.alias("names"), F.explode("annotations").alias("a")).select(
        F.col("a.image_id").alias("image_id"), F.col("a.id").alias("pos"), F.struct(F.coalesce(F.try_element_at("names", F.col("a.category_id")), F.concat(F.lit("category_"), F.col("a.category_id").cast("string"))).alias("label"), F.col("a.bbox").alias("bbox")).alias("region")
    )
    from ..operators.layout import collect_children

    return collect_children(images, notes, "image_id", F.col("region"), "pos", "regions")


# --- shards -------------------------------------------------------------

SHARD_SCHEMA = "shard string, pos int, sample_id string, sample_json string, target string, assets array<struct<name:string,payload:binary>>"
SHARD_BYTES = 256 * 1024 * 1024


class _Shard(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class ShardReader(DataSourceReader):
    """Tar shards in name order, one task each: ``.sample.json`` opens a record; the members that share its prefix are its target and assets."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, at = file_system(self.path)
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True)) if i.path.endswith(".tar") and i.type == fs.FileType.File)
        if not found:
            raise FileNotFoundError(f"no shards under {self.path}")
        return [_Shard(p) for p in found]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        current: list | None = None
        pos = 0
        system, _ = file_system(self.path)
        with system.open_input_stream(partition.path) as source, tarfile.open(fileobj=source, mode="r|") as t:
            for m in t:
                if not m.isfile():
                    continue
                data = t.extractfile(m).read()
                if m.name.endswith(".sample.json"):
                    if current:
                        yield tuple(current)
                    current = [partition.path.rpartition("/")[2], pos, m.name.removesuffix(".sample.json"), data.decode(), None, []]
                    pos += 1
                elif current and m.name.startswith(current[2] + "."):
                    if ".target." in m.name[len(current[2]) :]:
                        current[4] = data.decode()
                    else:
                        current[5].append((m.name[len(current[2]) + 1 :], data))
            if current:
                yield tuple(current)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]], rows: int) -> None:
        self.files, self.rows = files, rows


class ShardWriter(DataSourceWriter):
    """Tar shards of about ``target`` bytes. Tasks write hidden files; the commit names them in order, an abort removes them."""

    def __init__(self, path: str, target: int, columns: list[str]) -> None:
        self.path, self.target, self.columns = path, target, columns

    def write(self, rows: Iterator) -> _Written:
        import uuid

        system, at = file_system(self.path)
        system.create_dir(at, recursive=True)
        files: list[tuple[str, str]] = []
        out, stream, filled, count, first = None, None, 0, 0, ""

        def put(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))

        for row in self._guarded(rows, files):
            r = row.asDict(recursive=True)
            meta, target = (r["sample_json"] or "{}").encode(), (r["target"] or "").encode()
            size = len(meta) + len(target) + sum(len(a["payload"] or b"") for a in r["assets"] or [])
            if out is not None and filled + size > self.target:
                out.close()
                stream.close()
                out = None
            if out is None:
                hidden = f"{at}/.part-{uuid.uuid4().hex}"
                stream = system.open_output_stream(hidden)
                out, filled = tarfile.open(fileobj=stream, mode="w|"), 0
                first = r["sample_id"]
                files.append((first, hidden))
            kind = "md" if "markdown" in (r.get("target_type") or "") else "txt"
            put(f"{r['sample_id']}.sample.json", meta)
            put(f"{r['sample_id']}.target.{kind}", target)
            for a in r["assets"] or []:
                put(f"{r['sample_id']}.{a['name']}", a["payload"] or b"")
            filled += size
            count += 1
        if out is not None:
            out.close()
            stream.close()
        return _Written(files, count)

    def _guarded(self, rows: Iterator, files: list[tuple[str, str]]) -> Iterator:
        """The rows; a task that fails while it gets them leaves no hidden files behind."""
        try:
            yield from rows
        except BaseException:
            self._remove(files)
            raise

    def _remove(self, files: list[tuple[str, str]]) -> None:
        system, _ = file_system(self.path)
        for _, hidden in files:
            if system.get_file_info(hidden).type == fs.FileType.File:
                system.delete_file(hidden)

    def commit(self, messages: list[_Written]) -> None:
        system, at = file_system(self.path)
        for k, (_, hidden) in enumerate(sorted(f for m in messages if m for f in m.files)):
            system.move(hidden, f"{at}/shard-{k:06d}.tar")

    def abort(self, messages: list[_Written]) -> None:
        for m in messages:
            self._remove(m.files if m else [])


class ShardSource(DataSource):
    """``spark.read.format("shardtar").load(folder)`` and ``df.write.format("shardtar").mode("append").save(folder)``; the folder is shared."""

    @classmethod
    def name(cls) -> str:
        return "shardtar"

    def schema(self) -> str:
        return SHARD_SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("target_bytes", SHARD_BYTES)), schema.names)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ShardSource)


def shard_rows(samples: DataFrame) -> DataFrame:
    """Samples in the shape of shard records; ``sample_json`` holds all columns but the target."""
    meta = F.to_json(F.struct(*[c for c in samples.columns if c not in ("canonical_target", "assets")]))
    assets = F.transform("assets", lambda a: F.struct(a["name"].alias("name"), a["payload_bytes"].alias("payload"))) if "assets" in samples.columns else F.array().cast("array<struct<name:string,payload:binary>>")
    kind = F.col("target_type") if "target_type" in samples.columns else F.lit(None).cast("string")
    return samples.select("sample_id", meta.alias("sample_json"), F.col("canonical_target").alias("target"), kind.alias("target_type"), assets.alias("assets"))
