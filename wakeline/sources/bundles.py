"""Bundles of JSON lines whose manifest is the commit, as a data source; scans of many files of objects, with rejects by file and line.

A bundle is a folder: `<name>/part-*.ndjson` for each name, and a manifest with the size, rows and SHA-256 of every file, written last. Tasks write
beside the target; the folder takes its place in one rename, so a job that fails leaves what was there as it was. Reading checks the file set
and sizes before any task starts, and each file's digest while its lines go by; a bundle that differs fails the job.

The manifest has one entry a file, and files are as large as `max_bytes`: that, and nothing of the records, goes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wakeline.functions.hashing import canonical, canonical_json, text_digest
from wakeline.sources.sinks import compare_manifests, line_status, read_lines

MANIFEST = "bundle_manifest.json"
MANIFEST_TYPE = "wakeline.bundle.v1"
#: A file of a bundle is closed when it has grown beyond this, so that no reader has more than one such file to itself.
MAX_BYTES = 128 << 20
_BATCH_BYTES = 4 << 20


def pretty_json(value) -> str:
    """JSON to be read by people: sorted keys, two spaces, a newline at the end. Fails on what canonical JSON has no form for."""
    canonical_json(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True) + "\n"


def checked_name(name: str) -> str:
    """A name inside a bundle; fails if it is empty, absolute, leads out of the bundle, is not in plain form, or is the manifest's."""
    parts = PurePosixPath(name).parts
    bad = not parts or name.startswith("/") or ".." in parts or parts[-1] == MANIFEST or "/".join(parts) != name
    if bad or "\\" in name or ":" in name or any(ord(c) < 32 for c in name):
        raise ValueError(f"no name for a bundle: {name!r}")
    return name


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    files, root = pafs.FileSystem.from_uri(path)
    root = root.rstrip("/")
    if not root:
        raise ValueError("the root of a file system is no bundle")
    return files, root


def _listing(files: pafs.FileSystem, root: str) -> dict[str, int]:
    """Path inside the bundle -> size, of every file but the manifest."""
    found = files.get_file_info(pafs.FileSelector(root, recursive=True))
    sizes = {f.path.removeprefix(root).lstrip("/"): f.size for f in found if f.type == pafs.FileType.File}
    sizes.pop(MANIFEST, None)
    return sizes


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict]


@dataclass
class BundleFile(InputPartition):
    entry: dict


class _Part:
    """One file being written: its digest and size grow with it."""

    def __init__(self, files: pafs.FileSystem, root: str, name: str, file: str):
        self.name, self.path, self.bytes, self.rows, self.digest = name, f"{name}/{file}", 0, 0, hashlib.sha256()
        files.create_dir(f"{root}/{name}", recursive=True)
        self.out = files.open_output_stream(f"{root}/{self.path}")

    def add(self, record: str) -> None:
        line = (record + "\n").encode()
        self.out.write(line)
        self.digest.update(line)
        self.bytes += len(line)
        self.rows += 1

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name, "path": self.path, "bytes": self.bytes, "rows": self.rows, "sha256": "sha256:" + self.digest.hexdigest()}


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.names = [checked_name(n) for n in json.loads(options["names"])]
        self.header = {"bundle_type": options.get("bundle_type", ""), "metadata": json.loads(options.get("metadata", "{}"))}
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.attempt = uuid.uuid4().hex
        if not overwrite:
            self._refuse_full()

    def _refuse_full(self) -> None:
        files, root = _open(self.path)
        if files.get_file_info(root).type == pafs.FileType.Directory and files.get_file_info(pafs.FileSelector(root)):
            raise FileExistsError(f"the folder is not empty: {self.path}")

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        files, root = _open(self.path)
        return files, root, f"{root}.staging-{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staging = self._staging()
        at = TaskContext.get()
        open_parts, done, number = {}, [], 0
        for batch in iterator:
            for name, record in zip(batch.column("name").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if name not in self.names or record is None or "\n" in record or "\r" in record:
                    raise ValueError(f"no record of one line under a name of this bundle: {name!r}")
                part = open_parts.get(name)
                if part is None:
                    part = open_parts[name] = _Part(files, staging, name, f"part-{at.partitionId():06d}-{at.taskAttemptId()}-{number:04d}.ndjson")
                    number += 1
                part.add(record)
                if part.bytes >= self.max_bytes:
                    done.append(open_parts.pop(name).close())
        return Written(done + [p.close() for p in open_parts.values()])

    def commit(self, messages: list[Written | None]) -> None:
        files, root, staging = self._staging()
        files.create_dir(staging, recursive=True)
        entries = sorted((e for m in messages if m is not None for e in m.entries), key=lambda e: e["path"].encode())
        for stray in _listing(files, staging).keys() - {e["path"] for e in entries}:  # of attempts that were lost or overtaken
            files.delete_file(f"{staging}/{stray}")
        body = self.header | {"manifest_type": MANIFEST_TYPE, "files": entries, "bundle_digest": "sha256:" + text_digest(canonical_json(entries))}
        with files.open_output_stream(f"{staging}/{MANIFEST}") as out:
            out.write(pretty_json(body).encode())
        if not self.overwrite:
            self._refuse_full()
        if files.get_file_info(root).type == pafs.FileType.Directory:
            files.delete_dir(root)
        files.move(staging, root)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staging = self._staging()
        if files.get_file_info(staging).type == pafs.FileType.Directory:
            files.delete_dir(staging)


def load_manifest(path: str) -> dict:
    """The manifest of a bundle; fails if it is none, or if its list of files has not the digest that it states."""
    files, root = _open(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        body = json.loads(f.read())
    if body.get("manifest_type") != MANIFEST_TYPE or not isinstance(body.get("files"), list):
        raise ValueError(f"not a manifest of this kind: {path}")
    if body.get("bundle_digest") != "sha256:" + text_digest(canonical_json(body["files"])):
        raise ValueError(f"the bundle's digest differs: {path}")
    return body


class BundleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.names = json.loads(options["names"]) if "names" in options else None

    def partitions(self) -> list[InputPartition]:
        entries = load_manifest(self.path)["files"]
        stated, found = {e["path"]: e["bytes"] for e in entries}, _listing(*_open(self.path))
        if stated != found:
            differ = sorted(p for p in stated.keys() | found.keys() if stated.get(p) != found.get(p))
            raise ValueError(f"files missing, unexpected or of another size: {differ[:10]}")
        return [BundleFile(e) for e in entries if self.names is None or e["name"] in self.names] or [BundleFile({})]

    def read(self, partition: BundleFile) -> Iterator[pa.RecordBatch]:
        entry = partition.entry
        if not entry:
            return
        files, root = _open(self.path)
        digest, line, held, size = hashlib.sha256(), 0, [], 0
        with files.open_input_stream(f"{root}/{entry['path']}") as raw, pa.PythonFile(raw, mode="r") as f:
            rest = b""
            while chunk := f.read(1 << 20):
                digest.update(chunk)
                *whole, rest = (rest + chunk).split(b"\n")
                held += whole
                size += len(chunk)
                if size >= _BATCH_BYTES:
                    yield _lines(entry, line, held)
                    line, held, size = line + len(held), [], 0
        if held:
            yield _lines(entry, line, held)
        if rest or "sha256:" + digest.hexdigest() != entry["sha256"]:
            raise ValueError(f"the file's digest differs: {entry['path']}")


def _lines(entry: dict, before: int, records: list[bytes]) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.array([entry["name"]] * n), pa.array([entry["path"]] * n), pa.array(range(before + 1, before + n + 1), pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r.decode() for r in records])], names=["name", "file", "line", "record"])


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "name string, file string, line long, record string"

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options)

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options, overwrite)


def save_bundle(frames: dict[str, DataFrame], path: str, bundle_type: str, metadata: dict | None = None, force: bool = False, max_bytes: int = MAX_BYTES) -> None:
    """Each frame's rows as canonical JSON under its name, in one job with one commit.

    A folder that is not empty is refused, with force replaced; names are checked before any work. A frame without rows has no file. Null fields
    are written as null. A row without a canonical form (NaN, whole numbers beyond 2**53 - 1) fails the job, and nothing is left behind.
    """
    if not frames:
        raise ValueError("a bundle has at least one name")
    for name in frames:
        checked_name(name)
    _open(path)  # no root of a file system
    named = [df.select(F.lit(name).alias("name"), canonical(F.struct(*df.columns)).alias("record")) for name, df in frames.items()]
    records = reduce(DataFrame.unionByName, named)
    records.sparkSession.dataSource.register(BundleSource)
    options = {"names": json.dumps(list(frames)), "bundle_type": bundle_type, "metadata": json.dumps(metadata or {}), "max_bytes": str(max_bytes)}
    records.write.format("bundle").options(**options).mode("overwrite" if force else "append").save(path)


def read_bundle(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """name, file, line (from 1), record of a bundle's lines, of some names or all. Fails if files differ from the manifest; digests are checked of
    the files that are read."""
    spark.dataSource.register(BundleSource)
    reader = spark.read.format("bundle")
    return (reader.option("names", json.dumps(names)) if names is not None else reader).load(path)


def bundle_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, problem (missing, unexpected, changed) where a bundle differs from its manifest; no rows if it is intact."""
    stated = [(e["path"], e["bytes"], e["sha256"]) for e in load_manifest(path)["files"]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_extract("path", r"/([^/]+(?:/[^/]+)*)$", 1)
    root = _open(path)[1]
    relative = F.substring_index(F.concat(F.lit("/"), inside), root + "/", -1)
    found = files.select(relative.alias("file"), F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
    return compare_manifests(spark.createDataFrame(stated, "file string, bytes long, sha256 string"), found.filter(F.col("file") != MANIFEST))


def scan_objects(spark: SparkSession, paths: list[str], types: list[str] | None = None, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON lines in many files, and the rejects.

    Objects: file, line (from 1, blank lines counted), object_type, value; of some types, or all. Rejects: file, line, reason, value: invalid,
    not_object and range (see line_status), no_type where an object names no type, contract where it fails the condition `where` (over `v`, the line
    as a variant). Blank lines are neither. Every line is judged before types are chosen: a reject of another type is one too.
    """
    lines = read_lines(spark, paths).withColumn("status", line_status(F.col("value")))
    v = F.when(F.col("status") == "ok", F.parse_json("value"))
    typed = lines.withColumn("v", v).withColumn("object_type", F.try_variant_get("v", "$.object_type", "string"))
    holds = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    no_type = F.col("object_type").isNull()
    reason = F.when(F.col("status") != "ok", F.col("status")).when(no_type, "no_type").when(~holds, "contract")
    judged = typed.withColumn("reason", reason).filter("status <> 'blank'")
    good = judged.filter("reason IS NULL").select("file", "line", "object_type", "value")
    if types is not None:
        good = good.filter(F.col("object_type").isin(types))
    return good, judged.filter("reason IS NOT NULL").select("file", "line", "reason", "value")
