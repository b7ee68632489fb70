"""What the training-data operators share: staged tables, shared files, words and rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from waveloom.session import ship

#: Words are runs of anything but these ASCII white-space bytes; ``bytes.split()`` cuts at the same six.
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Small Arrow batches, unless someone has set a size: rows here are texts, and a batch of them is held whole in the
    executor and in its Python worker. And the package itself, for executors that have no copy of it."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if size not in spark.conf.getAll:
        spark.conf.set(size, "2000")
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI. Only a session on one machine may lack the setting; it
    gets a folder of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file:///tmp/waveloom-{uuid.uuid4().hex}")
        found = context.getCheckpointDir()
    return (found if "://" in found or found.startswith("file:") else f"file://{found}").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh URI in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **conf: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no
    recomputation. Spark deletes the shuffle files of the job when it ends, as nothing else reads them. ``conf`` holds
    for the job."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    conf = {k.replace("__", "."): v for k, v in conf.items()} | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared URI and the path in it, for use inside tasks."""
    scheme, _, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def compressed(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns.., z) of each row of ``docs``: z is the zstd-compressed UTF-8 text, null where the text is; texts are small to shuffle so."""
    whole = docs.select(*columns, F.col("text").cast("binary").alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=1).compress
        for batch in text_slices(batches, "z", 4 << 20):
            packed = pa.array([deflate(t) if t is not None else None for t in batch.column("z").to_pylist()], pa.binary())
            yield batch.set_column(len(columns), "z", packed)

    return whole.mapInArrow(run, whole.schema)


def inflated(column: pa.Array) -> list[bytes]:
    """The texts of a column that ``compressed`` made; null is empty."""
    inflate = zstandard.ZstdDecompressor().decompress
    return [inflate(z) if z is not None else b"" for z in column.to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sequence_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` values; entry ``i`` covers ``i .. i+k-1``. Runs of powers of two are doubled and joined."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, length, out, done = h ^ np.uint64(salt), 1, None, 0
    while True:
        if k & length:
            part = power[done : done + n]
            out = part if out is None else _mixed(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += length
        length *= 2
        if length > k:
            return out
        half = length // 2
        power = _mixed(power[: len(power) - half] * np.uint64(0xA0761D6478BD642F) + power[half:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    length = 1
    while length * 2 <= width:
        x = np.minimum(x[: len(x) - length], x[length:])
        length *= 2
    return np.minimum(x[:n], x[width - length : width - length + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tasks_for(spark: SparkSession, size: int, each: int) -> int:
    """A number of tasks for ``size`` bytes: ``each`` a task, and as many as there are cores before that."""
    return max(size // each, min(size // (1 << 20), spark.sparkContext.defaultParallelism)) + 1


def columns_of(df: DataFrame) -> list:
    """All columns, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
