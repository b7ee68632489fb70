"""Readers: manifests, untyped CSV, sectioned text, XML channels, discovery by path, and binary signal files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waveloom.functions.missing import number

FILEGROUP_SCHEMA = "filegroup_id long, title string, test_type string, make_model string, model_year int, status string, discovered_at string"
FILE_SCHEMA = "filegroup_id long, folder string, filename string, url string, status string, sha256 string, size_bytes long, error string"


def manifest(spark: SparkSession, path: str, schema: str = FILEGROUP_SCHEMA) -> DataFrame:
    """Line-delimited JSON with a fixed schema; fields that a line lacks are NULL."""
    return spark.read.schema(schema).json(path)


def sniffed_csv(spark: SparkSession, path: str, share: float = 0.75, least: int = 3) -> DataFrame:
    """CSV whose columns become numbers where at least max(3, 75 %) of the rows parse; ``Date`` and ``Time`` make ``timestamp``.

    Everything is read as text once; one aggregate counts what parses in all columns together.
    """
    raw = spark.read.csv(path, header=True)
    value = {c: _percent(F.col(f"`{c}`")) for c in raw.columns}
    counts = raw.agg(F.count("*").alias("_n"), *(F.count(v).alias(f"_{i}") for i, v in enumerate(value.values()))).first()
    need = max(least, share * counts["_n"])
    dated = {"Date", "Time"} <= set(raw.columns)
    picked = [F.try_to_timestamp(F.concat_ws(" ", "Date", "Time")).alias("timestamp")] if dated else []
    for i, (c, v) in enumerate(value.items()):
        if not (dated and c in ("Date", "Time")):
            picked.append((v if counts[f"_{i}"] >= need else F.col(f"`{c}`")).alias(c))
    return raw.select(*picked)


def _percent(c: Column) -> Column:
    return F.when(F.trim(c).endswith("%"), number(F.regexp_replace(F.trim(c), "%$", "")) / 100).otherwise(number(F.trim(c)))


def sectioned(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, key, value): ``---- name ----`` lines start sections of ``key = value`` lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", r"^-{2,}\s*(.*?)\s*-{2,}\s*$", 1), F.lit(""))
    marked = whole.withColumn("section", F.last(head, True).over(w)).filter(F.col("line").contains("=") & F.col("section").isNotNull())
    return marked.select("file", "section", "line_no", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))


CHANNEL_XML = "STRUCT<_Id: STRING, _Description: STRING, _Unit: STRING, _SampleRate: DOUBLE>"


def xml_channels(spark: SparkSession, path: str, row_tag: str = "Module") -> DataFrame:
    """Channels of instrument files, one row each, with their module's attributes."""
    schema = f"_SerialNumber STRING, _SampleRateHz DOUBLE, Channels STRUCT<Channel: ARRAY<{CHANNEL_XML}>>"
    modules = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return modules.select(F.col("_SerialNumber").alias("module"), F.explode("Channels.Channel").alias("c")).select("module", F.col("c._Id").alias("channel_id"), F.col("c._Description").alias("description"), F.col("c._Unit").alias("unit"), F.col("c._SampleRate").alias("sample_rate"))


def discovered(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file under a folder with size, extension and the id and title in a folder named ``123-title``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    part = r"/(\d+)-([^/]+)/"
    return files.select("path", "length", "modificationTime", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.regexp_extract("path", part, 1).try_cast("long").alias("filegroup_id"), F.regexp_extract("path", part, 2).alias("title"))


def guarded(files: DataFrame, content: str = "head", length: str = "length") -> DataFrame:
    """A status for each file: empty ones and login pages in place of files are skipped."""
    page = F.lower(F.substring(F.col(content).cast("string"), 1, 512)).rlike(r"<!doctype html|<html")
    return files.withColumn("status", F.when(F.col(length) == 0, "skipped_empty").when(page, "skipped_html").otherwise("pending"))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """A cell table (workbook, sheet, row, col, text) from files of delimited text, one sheet a file; workbooks in a binary format need a library that turns them into this."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("workbook"), F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1).alias("sheet"), F.posexplode(F.split("value", "\r?\n")).alias("row", "line"))
    return whole.select("workbook", "sheet", "row", F.posexplode(F.split("line", "\t|,")).alias("col", "text"))


class SignalFiles(DataSource):
    """Binary signal files: ``WLSG``, u32 channel count, then for each channel u32 name length, name, f64 step, u64 count and f64 values.

    Options: ``paths``, comma-separated. Each file is one partition; values are read channel by channel.
    """

    @classmethod
    def name(cls) -> str:
        return "waveloom_signals"

    def schema(self) -> str:
        return "file string, channel string, idx long, t double, v double"

    def reader(self, schema) -> DataSourceReader:
        return _SignalReader(self.options["paths"].split(","))


class _SignalReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import math

        with open(partition.value, "rb") as f:
            if f.read(4) != b"WLSG":
                raise ValueError(f"{partition.value} is no signal file")
            for _ in range(struct.unpack("<I", f.read(4))[0]):
                channel = f.read(struct.unpack("<I", f.read(4))[0]).decode()
                step, n = struct.unpack("<dQ", f.read(16))
                for i, (v,) in enumerate(struct.iter_unpack("<d", f.read(8 * n))):
                    yield partition.value, channel, i, i * step, None if math.isnan(v) else v


def signal_bytes(channels: dict[str, tuple[float, list[float]]]) -> bytes:
    """A signal file's contents."""
    out = [b"WLSG", struct.pack("<I", len(channels))]
    for name, (step, values) in channels.items():
        out += [struct.pack("<I", len(name.encode())), name.encode(), struct.pack("<dQ", step, len(values)), struct.pack(f"<{len(values)}d", *values)]
    return b"".join(out)
