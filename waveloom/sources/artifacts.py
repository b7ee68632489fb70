"""Files for people and for learners: tensor shards, and bundles of a case's files. What counts is what a manifest names, and it is written last.

Tensor shards come from a Python data source writer: a task writes shards under names of its own and tells the driver what it wrote; when
all tasks are done the manifest is written, and a job that fails takes its shards away. A bundle's files are copied and hashed
by tasks, and the table of what was copied, which Spark commits as one, is its manifest.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.json"
#: Rows of a shard at most.
SHARD_ROWS = 1024
#: Bytes that are copied at once.
PIECE = 8 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri)


class TensorFiles(DataSource):
    """Writes rows (case string, values array<array<float>>, mask array<array<tinyint>>) as NumPy shards: ``values-*.npy`` (cases x channels x
    samples, float32), ``mask-*.npy`` (int8), and a manifest of shards with their cases. Option ``path``; grids that differ raise ValueError."""

    @classmethod
    def name(cls) -> str:
        return "waveloom_tensors"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TensorWriter(self.options["path"], overwrite)


@dataclass
class _Shards(WriterCommitMessage):
    shards: list[dict]


class _TensorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        out: list[dict] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(lo, SHARD_ROWS)
                arrays = {}
                for name, kind in (("values", np.float32), ("mask", np.int8)):
                    rows = part.column(name).to_pylist()
                    if len({len(r) for r in rows}) > 1 or len({len(c) for r in rows for c in r}) > 1:
                        raise ValueError("cases or channels of a tensor have different grids")
                    arrays[name] = np.array(rows, kind).reshape(len(rows), len(rows[0]), -1)
                if arrays["values"].shape != arrays["mask"].shape:
                    raise ValueError("a mask differs from its values in shape")
                name = uuid.uuid4().hex
                for kind, array in arrays.items():
                    held = io.BytesIO()
                    np.save(held, array)
                    with system.open_output_stream(posixpath.join(root, f"{kind}-{name}.npy")) as f:
                        f.write(held.getvalue())
                out.append({"shard": name, "cases": [None if c is None else str(c) for c in part.column("case").to_pylist()], "shape": list(arrays["values"].shape)})
        return _Shards(out)

    def commit(self, messages) -> None:
        shards = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: (s["cases"][0] or "", s["shard"]))
        if len({tuple(s["shape"][1:]) for s in shards}) > 1:
            self.abort(messages)
            raise ValueError("cases of a tensor have different grids")
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        before = [] if self.overwrite else _manifest(self.path)
        old = _manifest(self.path) if self.overwrite else []
        held = posixpath.join(root, f".{uuid.uuid4().hex}")
        with system.open_output_stream(held) as f:
            f.write(json.dumps(before + shards).encode())
        system.move(held, posixpath.join(root, MANIFEST))
        _forget(self.path, old)

    def abort(self, messages) -> None:
        _forget(self.path, [s for m in messages if m is not None for s in m.shards])


def _manifest(path: str) -> list[dict]:
    system, root = opened(path)
    at = posixpath.join(root, MANIFEST)
    if system.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


def _forget(path: str, shards: list[dict]) -> None:
    system, root = opened(path)
    for s in shards:
        for kind in ("values", "mask"):
            system.delete_file(posixpath.join(root, f"{kind}-{s['shard']}.npy"))


def write_tensors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows (case, values, mask), as ``sinks.tensor`` makes them, as tensor shards in the folder ``path``, which all executors and the driver share."""
    df.sparkSession.dataSource.register(TensorFiles)
    ready = df.select(F.col(df.columns[0]).cast("string").alias("case"), F.col("values").cast("array<array<float>>").alias("values"), F.col("mask").cast("array<array<tinyint>>").alias("mask"))
    ready.write.format(TensorFiles.name()).mode(mode).option("path", path).save()


def read_tensors(path: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(cases, values, mask) of each shard that counts, one shard at a time; nothing if none was committed."""
    system, root = opened(path)
    for s in _manifest(path):
        arrays = []
        for kind in ("values", "mask"):
            with system.open_input_stream(posixpath.join(root, f"{kind}-{s['shard']}.npy")) as f:
                arrays.append(np.load(io.BytesIO(f.read())))
        yield s["cases"], *arrays


COPIED = "case string, role string, source string, name string, bytes long, sha256 string"


def bundle(files: DataFrame, root: str) -> DataFrame:
    """Copy the files (case, role, source) of each case into ``root``, hashing them on the way; returns and writes the manifest (case, role, source, name, bytes, sha256).

    A source that is null or does not exist has no copy: its name, bytes and hash are null. Files of equal content share one copy, named
    by its hash, so a task that runs twice leaves what one leaves. The manifest is a table in ``root`` that Spark commits when all are copied."""
    wanted = files.select(F.col("case").cast("string").alias("case"), "role", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        system.create_dir(posixpath.join(top, "files"), recursive=True)
        for batch in batches:
            found = []
            for source in batch.column("source").to_pylist():
                if source is None or (origin := opened(source))[0].get_file_info(origin[1]).type != pafs.FileType.File:
                    found.append((None, None, None))
                    continue
                held, hashed, size = posixpath.join(top, "files", f".{uuid.uuid4().hex}"), hashlib.sha256(), 0
                with origin[0].open_input_stream(origin[1]) as f, system.open_output_stream(held) as out:
                    while piece := f.read(PIECE):
                        hashed.update(piece)
                        out.write(piece)
                        size += len(piece)
                name = f"files/{hashed.hexdigest()}"
                system.move(held, posixpath.join(top, name))
                found.append((name, size, hashed.hexdigest()))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["case", "role", "source", "name", "bytes", "sha256"])

    wanted.mapInArrow(run, COPIED).write.mode("overwrite").parquet(f"{root}/manifest")
    return files.sparkSession.read.schema(COPIED).parquet(f"{root}/manifest")


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """The manifest's rows whose copy is missing (found null) or has another hash than it should (found)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            found = []
            for name in batch.column("name").to_pylist():
                at = posixpath.join(top, name)
                if system.get_file_info(at).type != pafs.FileType.File:
                    found.append(None)
                    continue
                hashed = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while piece := f.read(PIECE):
                        hashed.update(piece)
                found.append(hashed.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "found"])

    kept = spark.read.schema(COPIED).parquet(f"{root}/manifest").filter("name IS NOT NULL")
    return kept.mapInArrow(run, f"{COPIED}, found string").filter("found IS NULL OR found != sha256")
