"""Tensor shards and bundles: read back, damaged, failed."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.sources import artifacts, sinks

SCHEMA = "case long, values array<array<float>>, mask array<array<tinyint>>"


def rows(cases, samples=4):
    return [(c, [[float(c * 10 + k), *[0.5] * (samples - 1)] for k in range(2)], [[1] * samples, [0] * samples]) for c in cases]


def read(path):
    out = {}
    for cases, values, mask in artifacts.read_tensors(path):
        assert values.dtype == np.float32 and mask.dtype == np.int8 and values.shape == mask.shape == (len(cases), 2, values.shape[2])
        out |= {c: (values[i].tolist(), mask[i].tolist()) for i, c in enumerate(cases)}
    return out


def test_tensors(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read(path) == {}
    artifacts.write_tensors(spark.createDataFrame(rows(range(30)), SCHEMA).repartition(3), path)
    assert read(path) == {str(c): (v, m) for c, v, m in rows(range(30))}
    artifacts.write_tensors(spark.createDataFrame(rows([40]), SCHEMA), f"file://{path}", "append")
    assert len(read(path)) == 31
    artifacts.write_tensors(spark.createDataFrame(rows([7]), SCHEMA).coalesce(1), path)
    assert read(path) == {"7": rows([7])[0][1:]} and len(os.listdir(path)) == 3  # what was replaced is gone
    for bad in (rows([1]) + rows([2], 5), [(1, [[1.0], [1.0, 2.0]], [[1], [1, 1]])]):
        for parts in (1, 4):
            with pytest.raises(Exception, match="different grids"):
                artifacts.write_tensors(spark.createDataFrame(bad, SCHEMA).repartition(parts), path)
            assert read(path) == {"7": rows([7])[0][1:]}


def test_a_failed_task_leaves_nothing_that_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.write_tensors(spark.createDataFrame(rows([7]), SCHEMA), path)
    bad = spark.createDataFrame(rows(range(20)), SCHEMA).repartition(4).withColumn("case", F.when(F.col("case") == 13, F.raise_error(F.lit("broken"))).otherwise(F.col("case")))
    with pytest.raises(Exception, match="broken"):
        artifacts.write_tensors(bad, path)
    assert read(path) == {"7": rows([7])[0][1:]}


def test_series_as_tensor(spark, tmp_path):
    long = spark.createDataFrame([(c, k, i, i / 10, None if i == 1 else float(c + i)) for c in range(5) for k in ("a", "b") for i in range(3)], "case long, channel string, idx int, t double, v double")
    artifacts.write_tensors(sinks.tensor(long, "case", "channel", ["a", "b"]), str(tmp_path / "t"))
    assert read(str(tmp_path / "t"))["3"] == ([[3.0, 0.0, 5.0]] * 2, [[1, 0, 1]] * 2)


def test_bundle(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    contents = {"a": b"x" * 100_000, "b": b"", "c": b"x" * 100_000}
    for name, data in contents.items():
        (source / name).write_bytes(data)
    files = spark.createDataFrame([(1, "wide", str(source / "a")), (1, "long", f"file://{source / 'b'}"), (2, "wide", str(source / "c")), (2, "long", str(source / "none")), (3, "wide", None)], "case long, role string, source string").repartition(3)
    root = str(tmp_path / "out")
    for _ in range(2):
        got = {(r.case, r.role): (r.bytes, r.sha256) for r in artifacts.bundle(files, root).collect()}
        hashed = {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
        assert got == {("1", "wide"): hashed["a"], ("1", "long"): hashed["b"], ("2", "wide"): hashed["c"], ("2", "long"): (None, None), ("3", "wide"): (None, None)}
        assert sorted(os.listdir(f"{root}/files")) == sorted({h for _, h in hashed.values()})
    assert artifacts.damaged(spark, root).count() == 0
    (tmp_path / "out" / "files" / hashed["a"][1]).write_bytes(b"x" * 99_999 + b"y")
    (tmp_path / "out" / "files" / hashed["b"][1]).unlink()
    assert sorted((r.case, r.role, r.found is None) for r in artifacts.damaged(spark, root).collect()) == [("1", "long", True), ("1", "wide", False), ("2", "wide", False)]
