"""Runs, batches and replaced keys: what is done twice is done once."""

import pytest
from pyspark.sql import functions as F

from waveloom.streaming import ledger


def clock():
    n = iter(range(100))
    return lambda: f"t{next(n)}"


def test_runs(spark, tmp_path):
    book = ledger.Ledger(spark, f"{tmp_path}/runs", clock())
    assert book.runs().count() == 0
    with book.run("r1", "ingest", "first"):
        assert [r.status for r in book.runs().collect()] == ["running"]
    with pytest.raises(ZeroDivisionError), book.run("r2", "ingest"):
        1 / 0
    with book.run("r1", "ingest", "again"):
        pass
    got = {r.run: (r.started, r.finished, r.status, r.notes, r.error) for r in book.runs().collect()}
    assert got == {"r1": ("t4", "t5", "done", "again", None), "r2": ("t2", "t3", "error", "", "ZeroDivisionError: division by zero")}


def test_batches_replay(spark, tmp_path):
    path = f"{tmp_path}/rows"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        ledger.write_batch(df, path, "r1", 0)
        ledger.write_batch(df.filter("id = 1"), path, "r1", 1)
    ledger.write_batch(df, path, "r2", 0)
    assert sorted((r.run, r.batch, r.id) for r in spark.read.parquet(path).collect()) == [("r1", 0, 1), ("r1", 0, 2), ("r1", 1, 1), ("r2", 0, 1), ("r2", 0, 2)]


def test_keys_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = lambda *r: spark.createDataFrame(list(r), "doc long, line int")
    now = lambda: sorted(((r.doc, r.line) for r in spark.read.parquet(path).collect()), key=str)
    ledger.replace_keys(rows((1, 1), (1, 2), (2, 1), (None, 7)), path, "doc", 4)
    for _ in range(2):
        ledger.replace_keys(rows((1, 9), (3, 1), (None, 8)), path, "doc", 4)
        assert now() == sorted([(1, 9), (2, 1), (3, 1), (None, 8)], key=str)
    ledger.replace_keys(rows(), path, "doc", 4, spark.range(2, 4).select(F.col("id").alias("doc")))
    assert now() == sorted([(1, 9), (None, 8)], key=str)


def test_ingest(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    book = ledger.Ledger(spark, f"{tmp_path}/runs")
    seen = []

    def work(df, batch):
        ledger.replace_keys(df, out, "doc", 4)
        ledger.replace_keys(df, out, "doc", 4)  # as after a failure between the write and the commit of the batch
        seen.append(batch)

    for k, text in enumerate(['{"doc": 1, "v": 1}\n{"doc": 2, "v": 1}', '{"doc": 2, "v": 5}']):
        (source / f"{k}.json").write_text(text)
        for _ in range(2):  # the second run finds nothing new
            ledger.ingest(book, f"r{k}", "ingest", str(source), "doc long, v long", f"{tmp_path}/checkpoint", work)
    assert sorted((r.doc, r.v) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 5)] and len(seen) == 2
    assert {r.run: r.status for r in book.runs().collect()} == {"r0": "done", "r1": "done"}

    def fails(df, batch):
        raise ValueError("bad batch")

    (source / "3.json").write_text('{"doc": 9, "v": 9}')
    with pytest.raises(Exception, match="bad batch"):
        ledger.ingest(book, "r3", "ingest", str(source), "doc long, v long", f"{tmp_path}/checkpoint", fails)
    assert [r.status for r in book.runs().filter("run = 'r3'").collect()] == ["error"]
    ledger.ingest(book, "r3", "ingest", str(source), "doc long, v long", f"{tmp_path}/checkpoint", work)
    assert sorted((r.doc, r.v) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 5), (9, 9)]
