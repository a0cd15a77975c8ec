"""Readers on hand-made files."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cycle_analytics.operators import integrity
from cycle_analytics.operators.ledger import valid_catalog
from cycle_analytics.plans.restore import point_in_time_plan
from cycle_analytics.sources import packages, sinks, telemetry


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def package(root, chain, cycle, files, manifest='{"cycle_timestamp": "2026-06-20T01:58:17"}', extra_lines=(), alter=()):
    place = root / chain / cycle
    lines = ["# digests", ""]
    for i, (name, data) in enumerate(sorted(files.items())):
        digest = hashlib.sha256(data).hexdigest()
        lines.append(f"{digest} {'*' if i % 2 else ' '}{name}")
        write(place / name, b"altered" if name in alter else data)
    if manifest is not None:
        write(place / "manifest.json", manifest)
    write(place / "checksums.sha256", "\n".join([*lines, *extra_lines]) + "\n")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("incoming")
    package(root, "chain-v1", "20260620_015817", {"a.bin": b"aaa", "sub dir/b.bin": b"bb"})
    package(root, "chain-v1", "20260620_021928", {"a.bin": b"x"}, alter={"a.bin"})
    package(root, "chain-v2", "20260620_042019", {"c.bin": b"c"}, extra_lines=["0" * 64 + "  gone.bin"])
    package(root, "chain-v2", "20260620_044113", {"c.bin": b"c"}, manifest=None)
    package(
        root, "chain-v3", "20260620_064159", {"d.bin": b"d"}, extra_lines=["0" * 64 + "  checksums.sha256x"],
        manifest=json.dumps({"chain_version": "chain-v3", "pfc": {"scanned_sizes": {}}, "files": {"scanned_sizes": {"a": 4, "b": 5}}}),
    )
    write(root / ".hidden" / "20260620_000000" / "x.bin", b"x")
    return str(root)


def test_inventory_and_readiness(spark, root):
    found = {(r["chain_v"], r["cycle_id"]): (r["n_files"], r["bytes"]) for r in packages.cycles(spark, root).collect()}
    assert len(found) == 5 and found["chain-v1", "20260620_015817"][0] == 4
    files, lists = packages.files(spark, root), packages.checksum_lists(spark, root)
    assert {r["rel_path"] for r in lists.where("cycle_id = '20260620_015817'").collect()} == {"a.bin", "sub dir/b.bin"}
    ready = {r["cycle_id"]: r["ready"] for r in integrity.readiness(files, lists).collect()}
    assert ready == {
        "20260620_015817": True, "20260620_021928": False, "20260620_042019": False, "20260620_044113": False, "20260620_064159": False,
    }
    status = {(r["cycle_id"], r["rel_path"]): r["status"] for r in integrity.verified(lists, files).collect()}
    assert status["20260620_021928", "a.bin"] == "altered" and status["20260620_042019", "gone.bin"] == "missing"


def test_a_list_may_name_itself(spark):
    expected = spark.createDataFrame([("v", "c", "checksums.sha256", "0"), ("v", "c", "a", "1")], "chain_v string, cycle_id string, rel_path string, expected_sha256 string")
    actual = spark.createDataFrame([("v", "c", "a", "1"), ("v", "c", "extra", "9")], "chain_v string, cycle_id string, rel_path string, actual_sha256 string")
    checked = integrity.verified(expected, actual)
    assert {r["rel_path"]: r["status"] for r in checked.collect()} == {"checksums.sha256": "skipped", "a": "ok"}
    assert tuple(integrity.package_report(checked).first())[2:] == (1, 0)


def test_manifests(spark, root):
    rows = {r["cycle_id"]: r for r in packages.manifest_stamps(packages.manifests(spark, root)).collect()}
    assert rows["20260620_015817"]["cycle_at"] == datetime(2026, 6, 19, 18, 58, 17)
    assert rows["20260620_064159"]["stamp_error"] == "missing cycle_timestamp"
    summary = rows["20260620_064159"]["manifest_summary"]
    assert (summary["components"], summary["unstructured_raw_bytes"], summary["chain_version"]) == (["pfc", "files"], 9, "chain-v3")


def test_catalog_and_point_in_time_plan(spark, tmp_path):
    for n, stamp in (("20260620_010000", "2026-06-20T01:00:00"), ("20260620_020000", "2026-06-20T02:00:00+07:00"), ("20260620_030000", None)):
        doc = {"alg": "AES-256-GCM", "chain_v": "chain-v1", "cycle_id": n, **({"cycle_timestamp": stamp} if stamp else {})}
        write(tmp_path / "chain-v1" / f"{n}.tar.aes256gcm.meta.json", json.dumps(doc, indent=2))
    write(tmp_path / "chain-v1" / "bad.tar.aes256gcm.meta.json", "{nope")
    write(tmp_path / "chain-v1" / "noid.tar.aes256gcm.meta.json", '{"chain_v": "chain-v1", "cycle_id": ""}')
    catalog = packages.catalog_documents(spark, str(tmp_path), "chain-v1")
    assert sorted(r["cycle_id"] for r in catalog.collect()) == ["20260620_010000", "20260620_020000", "20260620_030000"]
    assert valid_catalog(catalog, with_stamp=True).count() == 2
    targets = spark.createDataFrame([("t1", "chain-v1", "2026-06-19 19:00:00"), ("t2", "chain-v1", "2026-06-19 18:30:00"), ("t0", "chain-v1", "2026-06-19 17:00:00")],
                                    "target_id string, chain_v string, target_at string").withColumn("target_at", F.col("target_at").cast("timestamp"))
    plan = point_in_time_plan(catalog, targets)
    assert sorted((r["target_id"], r["cycle_id"]) for r in plan.collect()) == [
        ("t1", "20260620_010000"), ("t1", "20260620_020000"), ("t2", "20260620_010000"),
    ]


def test_metric_charts(spark, tmp_path):
    write(tmp_path / "system_cpu-converted_p.csv", "timestamp,user (%),system (%),anomaly%,annotations\n01:28:48,-,-,-,-\n01:30:24,3,-,-,-\n")
    dropped = telemetry.converted_metric(spark, str(tmp_path / "system_cpu-converted_p.csv"), ["user", "system"], "2026-06-20").collect()
    assert [(r["host"], r["chart"], r["ts"], r["user"], r["system"]) for r in dropped] == [("primary", "system_cpu", datetime(2026, 6, 20, 1, 30, 24), 3.0, None)]
    zeroed = telemetry.converted_metric(spark, str(tmp_path / "system_cpu-converted_p.csv"), ["user", "system"], "2026-06-20", "zero").collect()
    assert [(r["user"], r["system"]) for r in zeroed] == [(0.0, 0.0), (3.0, 0.0)]
    write(tmp_path / "r-system_io-raw.csv", "timestamp,timestamp,anomaly%,annotations\n1781900067000,0.0834113,-,-\n")
    raw = telemetry.raw_metric(spark, str(tmp_path / "r-system_io-raw.csv"), ["stall_time"]).first()
    assert (raw["host"], raw["chart"], raw["ts"], raw["stall_time"]) == ("backup", "system_io", datetime(2026, 6, 20, 3, 14, 27), 0.0834113)


def test_workflow_csv_append_and_blanks(spark, tmp_path):
    path = str(tmp_path / "wf")
    row = ("2026-06-20T02:12:09.787145+07:00", "backup", "chain-v1", "c", 10, 38, 0.5, 1.5, None, 2.0)
    from cycle_analytics import schemas
    df = spark.createDataFrame([row], schemas.WORKFLOW).coalesce(1)
    sinks.append_csv(df, path)
    sinks.append_csv(df, path)
    back = telemetry.workflow_telemetry(spark, path).collect()
    assert len(back) == 2 and back[0]["duration_vm1_transfer_sec"] is None and back[0]["raw_size_bytes"] == 10
    assert back[0]["ended_at"] == datetime(2026, 6, 20, 2, 12, 9, 787145)
    docs = str(tmp_path / "docs")
    sinks.append_documents(df.select("workflow_type", "chain_v", "duration_vm1_transfer_sec"), docs)
    assert spark.read.text(docs).first()[0] == '{"chain_v":"chain-v1","workflow_type":"backup"}'


LOG = """[2031-03-04T10:00:05+0700] waiting for cycle x9: two files not ready
[2031-03-04T10:00:20+0700] == processing cycle red/x9 ==
[2031-03-04T10:03:10+0700] == done cycle red/x9 ==
[2031-03-04T11:11:11+0700] <GOOD> all is well
no stamp here
"""


def test_service_log(spark, tmp_path):
    write(tmp_path / "service.log", LOG)
    log = packages.service_log(spark, str(tmp_path / "service.log"))
    assert log.where(F.col("message").contains("not ready")).count() == 1
    assert [r["message"][:11] for r in log.where("level = 'GOOD'").collect()] == ["all is well"]
    spans = packages.cycle_progress(log).collect()
    assert [(r["chain_v"], r["cycle_id"], r["seconds"]) for r in spans] == [("red", "x9", 170.0)]


def test_charts_bind_columns_by_name(spark, tmp_path):
    from cycle_analytics.sources import charts

    write(tmp_path / "p-system_load-converted.csv", 'timestamp,load1 (load), "load5 (load)" ,anomaly%,annotations\n01:00:00,1.5,-,0,"a, b"\n\n01:00:09,2,3\n')
    write(tmp_path / "more" / "r-system_stall-raw.csv", "annotations,timestamp\n")  # its first cell is no stamp
    write(tmp_path / "more" / "r-io-raw.csv", "Timestamp,timestamp,timestamp\r\n1781900067000,7,8\r\n")
    found = charts.metric_charts(spark, str(tmp_path), "2026-06-20")
    rows = sorted((r.host, r.chart, r.dim, r.unit, r.ts.isoformat(), r.value) for r in found.collect())
    assert rows == [
        ("backup", "io", "timestamp", None, "2026-06-20T03:14:27", 7.0), ("backup", "io", "timestamp_2", None, "2026-06-20T03:14:27", 8.0),
        ("primary", "system_load", "load1", "load", "2026-06-20T01:00:00", 1.5), ("primary", "system_load", "load1", "load", "2026-06-20T01:00:09", 2.0),
        ("primary", "system_load", "load5", "load", "2026-06-20T01:00:09", 3.0),
    ]
    zero = charts.metric_charts(spark, str(tmp_path), "2026-06-20", "zero").where("dim = 'load5'").collect()
    assert sorted(r.value for r in zero) == [0.0, 3.0]
