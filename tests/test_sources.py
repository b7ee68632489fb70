"""Readers, writers, audits and incremental ingest on small files."""

from waveloom.operators import relational
from waveloom.plans import audit
from waveloom.sources import sinks, tables
from waveloom.streaming import ingest


def test_sniffed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,Humidity,mixed,n\n" + "".join(f"2020-01-0{i},10:00:00,{i}0%,{'x' if i > 2 else i},{i}.5\n" for i in range(1, 6)))
    df = tables.sniffed_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"timestamp": "timestamp", "Humidity": "double", "mixed": "string", "n": "double"}
    assert df.agg({"Humidity": "max"}).first()[0] == 0.5


def test_sections_xml_and_discovery(spark, tmp_path):
    root = tmp_path / "12-Some Car" / "DAS"
    root.mkdir(parents=True)
    (root / "Equipment.ini").write_text("---- Rack ----\nRackID = 7\nConnectInfo=a=b\n---- Other ----\nk=v\nnothing\n")
    (root / "t.dts").write_text('<Test><Module SerialNumber="S1" SampleRateHz="10000"><Channels><Channel Id="1" Description="Head X" Unit="g" SampleRate="10000"/><Channel Id="2"/></Channels></Module></Test>')
    ini = tables.sectioned(spark, str(root / "Equipment.ini")).orderBy("line_no").collect()
    assert [(r["section"], r["key"], r["value"]) for r in ini] == [("Rack", "RackID", "7"), ("Rack", "ConnectInfo", "a=b"), ("Other", "k", "v")]
    assert [r["description"] for r in tables.xml_channels(spark, str(root / "t.dts")).orderBy("channel_id").collect()] == ["Head X", None]
    found = tables.discovered(spark, str(tmp_path)).orderBy("extension").collect()
    assert [(r["filegroup_id"], r["extension"]) for r in found] == [(12, "dts"), (12, "ini")]


def test_guard(spark):
    df = spark.createDataFrame([(0, b""), (9, b"<!DOCTYPE html><html>login"), (9, b"data")], "length long, head binary")
    assert [r["status"] for r in tables.guarded(df).collect()] == ["skipped_empty", "skipped_html", "pending"]


def test_signal_source(spark, tmp_path):
    path = tmp_path / "a.wlsg"
    path.write_bytes(tables.signal_bytes({"x": (0.1, [1.0, float("nan"), 3.0]), "y": (0.2, [])}))
    spark.dataSource.register(tables.SignalFiles)
    rows = spark.read.format("waveloom_signals").option("paths", str(path)).load().collect()
    assert [(r["channel"], r["idx"], r["v"]) for r in rows] == [("x", 0, 1.0), ("x", 1, None), ("x", 2, 3.0)]


def test_replace_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "lake")
    a = spark.createDataFrame([(1, "m"), (2, "n")], "v long, mode string")
    sinks.write_lake(a, path, ["mode"])
    for _ in range(2):
        sinks.write_lake(spark.createDataFrame([(5, "m")], "v long, mode string"), path, ["mode"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(2, "n"), (5, "m")]


def test_export_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
    sinks.export_csv(df, str(tmp_path / "out"), ["k"], bom=True)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.lstrip('"').startswith("﻿k") and text.index("a") < text.index("b")
    out = relational.upsert(df, spark.createDataFrame([(2, "z", 1)], "k long, v string, n long"), ["k"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", None), (2, "z", 1)]


def test_audit(spark):
    cases = spark.createDataFrame([(1,), (2,)], "id long")
    out = audit.stage_audit(cases, {"a": cases, "b": cases.filter("id = 1")}, "id")
    assert {r["id"]: (r["gaps"], r["complete"]) for r in out.collect()} == {1: ("", 1), 2: ("b", 0)}
    assert audit.gap_reasons(out).first()["gap"] == "b"
    files = spark.createDataFrame([(1, "done"), (1, "error"), (2, "done")], "id long, status string")
    assert {r["id"]: r["state"] for r in audit.rolled_up(files, "id").collect()} == {1: "error", 2: "downloaded"}


def test_incremental_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"k": 1}\n')
    seen = []
    work = lambda df, _: seen.append(sorted(r["k"] for r in df.collect()))
    for _ in range(2):
        ingest.ingest_new(spark, str(tmp_path / "in"), "k long", str(tmp_path / "cp"), work)
    (tmp_path / "in" / "2.json").write_text('{"k": 2}\n')
    ingest.ingest_new(spark, str(tmp_path / "in"), "k long", str(tmp_path / "cp"), work)
    assert [s for s in seen if s] == [[1], [2]]
