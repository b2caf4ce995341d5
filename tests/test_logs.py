"""Logs survive the round trip, and only the asked device is replaced."""

import csv
import glob

from pyspark.sql import functions as F

from fleetair.checks import flows
from fleetair.sources import logs


def test_csv_has_fixed_decimals_and_one_header_per_file(spark, sf, tmp_path):
    path = str(tmp_path / "log")
    logs.write_sensor_log(flows.log_rows(spark, sf).where("device_id = 'AA:BB:CC'"), path, fmt="csv")
    files = glob.glob(f"{path}/bucket=*/period=2024-01/*.csv")
    assert files
    with open(files[0]) as f:
        header, first = f.readline().strip().split(","), f.readline().strip().split(",")
        times = [int(line.split(",")[1]) for line in f]
    assert times == sorted(times) and len(times) > 5
    assert header[:2] == ["device_id", "timestamp_ms"] and header[-1] == "event_name" and len(header) == 20
    row = dict(zip(header, first))
    for name, digits in (("temperature", 2), ("iaq", 1), ("o3_ppb", 3), ("rmox_3", 3)):
        assert len(row[name].split(".")[1]) == digits


def test_replace_with_nothing_clears_one_device(spark, sf, tmp_path):
    path = str(tmp_path / "log")
    rows = flows.log_rows(spark, sf)
    logs.write_sensor_log(rows, path)
    before = logs.read_log(spark, path).count()
    mine = rows.where("device_id = 'AA:BB:CC'").count()
    logs.replace_log(rows.where("device_id = 'a+b'"), path, "AA:BB:CC")
    after = logs.read_log(spark, path)
    assert mine > 0
    assert after.count() == before - mine
    assert after.where("device_id = 'AA:BB:CC'").count() == 0


def test_device_from_file_name(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    head = ",".join(f.name for f in logs.LOG.fields)
    row = "5," + ",".join(["1.5"] * 4) + ",3," + ",".join(["2.5"] * 11) + ",1,MODERATE"
    (folder / "kitchen.csv").write_text(f"{head}\n{row}\n")
    out = logs.scan_sensor_log(spark, str(folder)).collect()
    assert [(r.device_id, r.timestamp_ms, r.iaq_accuracy, r.label, r.event_name) for r in out] == [
        ("kitchen", 5, 3, 1, "MODERATE")]


def test_export_is_in_time_order(spark, sf, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    logs.write_sensor_log(flows.log_rows(spark, sf), path)
    logs.export_log(spark, path, out)
    times = []
    for name in sorted(glob.glob(f"{out}/*.csv")):
        with open(name) as f:
            assert f.readline().startswith("device_id,ts,timestamp_ms")
            times += [tuple(x[:2]) for x in csv.reader(f)]
    assert times == sorted(times) and len(times) == flows.log_rows(spark, sf).count()


def test_union_fills_missing_columns(spark):
    a = spark.range(2).withColumn("x", F.lit(1))
    assert logs.union_logs(a, spark.range(3)).where("x is null").count() == 3


def test_any_id_comes_back(spark, tmp_path):
    """Ids stay text and stay apart, in both formats, also after a replacement."""
    ids = [*flows.DEVICE_NAMES, "", " x ", 'q"r', "dev 1", "1", "01", "a/b", "é,\n"]
    rows = spark.createDataFrame(
        [(d, i, float(i)) for i, d in enumerate(ids)], "device_id string, timestamp_ms long, temperature float"
    ).withColumn("ts", F.timestamp_millis("timestamp_ms"))
    shown = lambda df: sorted(((r.device_id, r.timestamp_ms, r.temperature) for r in df.collect()), key=repr)
    want = shown(rows)
    path = str(tmp_path / "log")
    logs.write_sensor_log(rows, path)
    assert shown(logs.read_log(spark, path)) == want
    for d in ids:
        logs.replace_log(rows, path, d)
    assert shown(logs.read_log(spark, path)) == want
    assert shown(logs.read_log(spark, path, "01")) == [r for r in want if r[0] == "01"]
    # A line feed would need multi-line CSV, and an empty id is CSV's NULL.
    plain = rows.where("device_id IS NULL OR device_id <> '' AND NOT contains(device_id, '\\n')")
    logs.write_sensor_log(plain, str(tmp_path / "csv"), fmt="csv")
    assert shown(logs.scan_sensor_log(spark, str(tmp_path / "csv"))) == shown(plain)


def test_files_of_any_header_are_read_by_name(spark, tmp_path):
    """Columns may stand in another order in every file, or be fewer."""
    folder = tmp_path / "in [1] a+b %41"
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp_ms,humidity,temperature\n5,40,20\n6,41,21\n")
    (folder / "b.csv").write_text("timestamp_ms,temperature,humidity\n7,22,42\n")
    (folder / "c.csv").write_text('"timestamp_ms","iaq"\n8,99.5\n')
    (folder / "d.csv").write_text("timestamp_ms,temperature,humidity\n")
    got = {(r.device_id, r.timestamp_ms, r.temperature, r.humidity, r.iaq) for r in logs.scan_sensor_log(spark, logs._literal(str(folder))).collect()}
    assert got == {("a", 5, 20.0, 40.0, None), ("a", 6, 21.0, 41.0, None), ("b", 7, 22.0, 42.0, None), ("c", 8, None, None, 99.5)}


def test_bad_fields_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp_ms,temperature\n5,20\nx,21\n7,warm\n")
    got = logs.scan_sensor_log(spark, str(tmp_path / "a.csv"), bad="line").select("timestamp_ms", "temperature", "line").collect()
    assert [tuple(r) for r in got] == [(5, 20.0, None), (None, 21.0, "x,21"), (7, None, "7,warm")]


def shown(df):
    return sorted(((r.device_id, r.timestamp_ms, r.temperature) for r in df.collect()), key=repr)


def some_rows(spark, values, temperature):
    return spark.createDataFrame(
        [(d, i, temperature) for i, d in enumerate(values)], "device_id string, timestamp_ms long, temperature float"
    ).withColumn("ts", F.timestamp_millis("timestamp_ms"))


KILLED = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from fleetair.sources import logs
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
logs._publish = lambda *a: os._exit(7)  # killed when the rows are written and the manifest is not
rows = spark.createDataFrame([("b", 9, 99.0)], "device_id string, timestamp_ms long, temperature float")
logs.replace_log(rows.withColumn("ts", F.timestamp_millis("timestamp_ms")), sys.argv[2], "b")
"""


def test_a_job_killed_between_its_writes_leaves_the_old_log(spark, tmp_path):
    import subprocess
    import sys

    from conftest import ROOT

    path = str(tmp_path / "log")
    logs.write_sensor_log(some_rows(spark, ["a", "b", "b", "c"], 1.0), path)
    before = shown(logs.read_log(spark, path))
    done = subprocess.run([sys.executable, "-c", KILLED, ROOT, path], capture_output=True, timeout=120)
    assert done.returncode == 7, done.stderr[-2000:]
    assert len(glob.glob(f"{path}/rows/folder=*")) == 2  # its rows are there
    assert shown(logs.read_log(spark, path)) == before
    # The log goes on from there, and what was left behind stays out of sight.
    logs.replace_log(some_rows(spark, ["b"], 5.0), path, "b")
    logs.write_sensor_log(some_rows(spark, ["b", None], 6.0), path)
    assert shown(logs.read_log(spark, path)) == sorted(
        [("a", 0, 1.0), ("b", 0, 5.0), ("b", 0, 6.0), ("c", 3, 1.0), (None, 1, 6.0)], key=repr)
    assert shown(logs.read_log(spark, path, "b")) == [("b", 0, 5.0), ("b", 0, 6.0)]


def test_restart_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    for mode, t in (("append", 1.0), ("overwrite", 2.0), ("append", 3.0)):
        logs.write_sensor_log(some_rows(spark, ["a", "b"], t), path, mode)
    logs.replace_log(some_rows(spark, [], 0.0), path, "a")
    assert shown(logs.read_log(spark, path)) == [("b", 1, 2.0), ("b", 1, 3.0)]
    more = some_rows(spark, ["z"], 4.0).withColumn("iaq", F.lit(7.0))
    logs.write_sensor_log(more, path)
    logs.compact_log(spark, path)
    got = logs.read_log(spark, path)
    assert shown(got) == [("b", 1, 2.0), ("b", 1, 3.0), ("z", 0, 4.0)]
    assert [r.iaq for r in got.where("iaq IS NOT NULL").collect()] == [7.0]
    assert logs._manifest(spark, path).count() == 1
