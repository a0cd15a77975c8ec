"""Reports on small telemetry tables with recorded and hand-computed values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cycle_analytics import schemas
from cycle_analytics.functions.clock import wall_clock
from cycle_analytics.plans import reports

# Recorded values of one full and one incremental cycle.
FULL = dict(
    timestamp="2026-06-20T01:59:27+07:00", cycle_id="20260620_015817", chain_version="chain-v1", pg_basebackup_s=7.413,
    mongo_basebackup_s=0.404, pg_wal_extract_s=0.443, pg_wal_compress_s=0.0, mongo_oplog_extract_s=1.678,
    mongo_oplog_compress_s=0.026, unstructured_chunk_s=13.715, unstructured_delta_compress_s=0.0, verify_s=4.983,
    retention_s=0.008, transfer_s=15.825, total_cycle_s=70.02, pg_wal_raw_bytes=83886418, pg_basebackup_raw_bytes=3352764,
    mongo_oplog_raw_bytes=1162214, mongo_basebackup_raw_bytes=18677, unstructured_raw_bytes=1060364381,
    pg_wal_stored_bytes=2093724, mongo_oplog_stored_bytes=40167, unstructured_stored_bytes=396137029,
    cycle_total_stored_bytes=796133422, wal_file_count=6, pfc_chunk_count=1046, pg_raw_size=3352764,
    pg_compressed_size=3352764, mongo_raw_size=1180891, mongo_compressed_size=58844, unstr_raw_size=1454201092,
    unstr_compressed_size=789973740, cycle_raw_total_size=1458734747, cycle_final_transfered_size=796133422,
    unstr_base_s=22.688, unstr_base_size=393836711,
)
DELTA = dict(
    timestamp="2026-06-20T02:19:41+07:00", cycle_id="20260620_021928", chain_version="chain-v1", pg_basebackup_s=0.0,
    mongo_basebackup_s=0.0, pg_wal_extract_s=0.24, pg_wal_compress_s=0.0, mongo_oplog_extract_s=2.37,
    mongo_oplog_compress_s=0.035, unstructured_chunk_s=5.077, unstructured_delta_compress_s=0.0, verify_s=0.446,
    retention_s=0.002, transfer_s=4.587, total_cycle_s=13.404, pg_wal_raw_bytes=67108864, pg_basebackup_raw_bytes=0,
    mongo_oplog_raw_bytes=2058939, mongo_basebackup_raw_bytes=0, unstructured_raw_bytes=317214728,
    pg_wal_stored_bytes=702554, mongo_oplog_stored_bytes=74628, unstructured_stored_bytes=265613155,
    cycle_total_stored_bytes=266601688, wal_file_count=4, pfc_chunk_count=318, pg_raw_size=0, pg_compressed_size=0,
    mongo_raw_size=2058939, mongo_compressed_size=74628, unstr_raw_size=317214728, unstr_compressed_size=265613155,
    cycle_raw_total_size=319273667, cycle_final_transfered_size=266601688, unstr_base_s=0.0, unstr_base_size=0,
)


@pytest.fixture(scope="module")
def backups(spark):
    other = {**DELTA, "timestamp": "2026-06-20T04:21:13+07:00", "cycle_id": "20260620_042019", "chain_version": "chain-v2"}
    names = [c.split()[0] for c in schemas.BACKUP.split(", ")]
    rows = [tuple(r[n] for n in names) for r in (FULL, DELTA, other)]
    df = spark.createDataFrame(rows, schemas.BACKUP).coalesce(1)
    return df.withColumn("ended_at", wall_clock(F.col("timestamp"))).cache()


@pytest.fixture(scope="module")
def workflows(spark):
    rows = [
        ("2026-06-20T02:12:09.787145+07:00", "backup", "chain-v1", "20260620_015817", 798156800, 798156828, 6.0766, 482.7418, None, 489.1711),
        ("2026-06-20T02:22:02.824744+07:00", "backup", "chain-v1", "20260620_021928", 267253760, 267253788, 1.0795, 137.0639, None, 138.305),
        ("2026-06-20T08:57:30+07:00", "restore", "chain-v1", "20260620_015817", 798156800, 798156828, 5.0, 0.0, 9.0, 40.0),
        ("2026-06-20T08:58:00+07:00", "restore", "chain-v1", "20260620_021928", 267253760, 267253788, 1.0, 0.0, 3.0, 10.0),
    ]
    df = spark.createDataFrame(rows, schemas.WORKFLOW).coalesce(1)
    return df.withColumn("ended_at", wall_clock(F.col("timestamp"))).cache()


def test_cycle_durations(backups):
    rows = {r["cycle_id"]: r for r in reports.cycle_durations(backups).collect()}
    assert rows["20260620_015817"]["other_stages_s"] == pytest.approx(3.718)
    assert rows["20260620_021928"]["other_stages_s"] == pytest.approx(0.924)
    assert rows["20260620_015817"]["clock"] == "01:59"
    assert [rows[k]["chain_changed"] for k in sorted(rows)] == [False, False, True]


def test_volumes_and_labels(backups):
    rows = reports.cycle_volumes(backups).collect()
    assert [r["label"] for r in rows] == ["v1-C1", "v1-C2", "v2-C1"]
    assert rows[0]["raw_mib"] == pytest.approx(1458734747 / 1024**2)


def test_engine_matrix_and_audit(backups):
    rows = reports.engine_matrix(backups).orderBy("chain_version", "cycle_name").collect()
    assert rows[0]["total_raw"] == 1542621165 and rows[1]["total_raw"] == 386382531
    assert round(rows[0]["total_eff_pct"], 2) == 48.43 and round(rows[1]["total_eff_pct"], 2) == 31.06
    assert rows[1]["pg_base_eff_pct"] == 0.0
    assert len(rows[0]) == 35
    assert reports.engine_matrix(backups, "pg").columns[-1] == "wal_files"
    assert len(reports.engine_matrix(backups, "mongo").columns) == 10
    assert len(reports.engine_matrix(backups, "unstr").columns) == 11
    audit = reports.engine_audit(backups).first()
    assert (audit["rows"], audit["unstr_total_raw"], audit["mongo_total_raw"], audit["transferred"], audit["stored_parts"]) == (3, 0, 0, 0, 3)
    gaps = {r["cycle_id"]: r["recorded"] - r["computed"] for r in reports.engine_offenders(backups).collect()}
    assert gaps["20260620_015817"] == 654350 and gaps["20260620_021928"] == 211351


def test_restore_composition(spark):
    names = [c.split()[0] for c in schemas.RESTORE.split(", ")]
    row = dict.fromkeys(names, 0)
    row.update(
        timestamp="2026-06-20T09:01:12+07:00", target_chain_version="chain-v1", target_cycle_count=7, verify_s=4.176,
        unstructured_restore_s=162.44, pg_wal_stage_s=3.578, pg_basebackup_restore_s=0.191, mongo_oplog_restore_s=0.297,
        mongo_basebackup_restore_s=0.005, total_restore_s=170.711, unstructured_restored_raw_bytes=1187308221,
        pg_wal_restored_raw_bytes=486539602, pg_basebackup_restored_raw_bytes=3352764,
        mongo_oplog_restored_raw_bytes=13387732, mongo_basebackup_restored_raw_bytes=18677,
    )
    got = reports.restore_composition(spark.createDataFrame([tuple(row[n] for n in names)], schemas.RESTORE)).first()
    assert round(got["restored_gib"], 4) == 1.5745
    assert got["other_s"] == pytest.approx(170.711 - 162.44 - 3.578 - 4.176)


def test_throughput_table_and_test(spark, workflows):
    rows = {(r["workflow_type"], r["cycle_n"]): r for r in reports.workflow_throughput(workflows).collect()}
    assert rows["backup", 1]["throughput_mib_s"] == pytest.approx(798156800 / 1048576 / 489.1711)
    assert rows["restore", 2]["label"] == "chain-v1-C2"
    table = [tuple(r) for r in reports.transfer_table(workflows).orderBy("cycle").collect()]
    assert table[0] == ("v1-C1", "798,156,800", "761.18", "482.74", "1.58")
    tested = reports.throughput_test(spark, workflows).first()
    assert tested["n_1"] == tested["n_2"] == 2 and 0 < tested["p"] < 1


def test_resource_stats_keep_events_without_samples(spark, backups):
    end = datetime(2026, 6, 20, 1, 59, 27)
    cpu = spark.createDataFrame(
        [(end + timedelta(seconds=35), 20.0, 10.0, 1.0, 2.0), (end + timedelta(seconds=36), 90.0, 0.0, 0.0, 0.0)],
        "ts timestamp_ntz, user double, system double, softirq double, iowait double",
    )
    ram = spark.createDataFrame(
        [(end, 1.0, 1.0, 1.0, 1.0), (end - timedelta(seconds=100), 3.0, 1.0, 0.0, 0.0)],
        "ts timestamp_ntz, used double, free double, cached double, buffers double",
    )
    got = reports.resource_stats(backups, "total_cycle_s", "chain_version", "Backup-Tel: ", reports.primary_metrics(cpu, ram), 35)
    rows = {r["name"]: r for r in got.collect()}
    first, second = rows["Backup-Tel: v1-C1"], rows["Backup-Tel: v1-C2"]
    assert (first["cpu_n"], first["cpu_max"], first["ram_n"], first["ram_max"], first["ram_avg"]) == (1, 33.0, 2, 75.0, 50.0)
    assert (second["cpu_n"], second["cpu_max"], second["ram_max"]) == (0, None, None)
    monitor = spark.createDataFrame([(end, 5.0, (1, 1, 40.0))], "ts timestamp_ntz, cpu_percent double, memory struct<total_bytes:int,available_bytes:int,percent_used:double>")
    vm2 = reports.resource_stats(backups, "total_cycle_s", "chain_version", "", reports.monitor_metrics(monitor), 15)
    assert {r["name"]: r["ram_max"] for r in vm2.collect()} == {"v1-C1": 40.0, "v1-C2": None, "v2-C1": None}


def test_restore_validation_rules(spark):
    t = datetime(2026, 6, 20, 1)
    minute = timedelta(minutes=1)
    backups = spark.createDataFrame([("v1", t, "c1"), ("v1", t + 10 * minute, "c2")], "chain string, ended_at timestamp_ntz, cycle_id string")
    restores = spark.createDataFrame(
        [(1, "v1", 2, t + 60 * minute), (2, "v1", 3, t + 60 * minute), (3, "v1", 1, t + 90 * minute)],
        "restore_id int, chain string, n int, restored_at timestamp_ntz",
    ).withColumn("n", F.col("n").cast("bigint"))
    points = spark.createDataFrame(
        [("pg", t, 5), ("pg", t + 5 * minute, 9), ("pg", t + 10 * minute, 7), ("pg", t + 61 * minute, 9), ("pg", t + 63 * minute, 50),
         ("files", t + 20 * minute, 1), ("files", t + 60 * minute, 99)],
        "source string, ts timestamp_ntz, value int",
    )
    rows = {r["restore_id"]: r for r in reports.restore_validation(backups, restores, points, ["pg", "files"]).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1]["pg_target"], rows[1]["pg_restored"], rows[1]["pg_status"]) == (9, 9, "✅ Valid")
    assert (rows[1]["files_target"], rows[1]["files_restored"], rows[1]["files_status"]) == (0, 0, "Delta (nan)")
    assert (rows[3]["pg_target"], rows[3]["pg_restored"], rows[3]["pg_status"]) == (5, 0, "Delta (-5)")
    assert rows[1]["target_cycle"] == "Cycle 2" and rows[1]["restore_time"] == "02:00:00"


def test_growth_panels_and_timeline(spark, backups):
    t = datetime(2026, 6, 20, 1)
    minute = timedelta(minutes=1)
    snaps = spark.createDataFrame([(t + i * minute, i * 10) for i in range(10)], "ts timestamp_ntz, orders_total int")
    restores = spark.createDataFrame([("v1", t + 2 * minute), ("v2", t + 30 * minute)], "target_chain_version string, ended_at timestamp_ntz")
    series, levels = reports.growth(snaps, "orders_total", restores, F.lit(t + 4 * minute))
    assert series.count() == 5
    assert [(r["target_chain_version"], r["restored_level"]) for r in levels.collect()] == [("v1", 40)]
    panels = reports.split_panels(snaps, F.lit(t + 3 * minute), F.lit(t + 5 * minute)).groupBy("panel").count()
    assert {r["panel"]: r["count"] for r in panels.collect()} == {"left": 4, "right": 2}

    spans = spark.createDataFrame([("backup", t + 2 * minute, t + 3 * minute)], "kind string, start timestamp_ntz, end timestamp_ntz")
    samples = spark.createDataFrame([(t + i * minute, float(i)) for i in range(10)], "ts timestamp_ntz, cpu double")
    line = reports.usage_timeline(samples, spans, "ts", "cpu", kind="backup", before=2, after=1)
    rows = line.orderBy("slot").collect()
    assert [r["is_imputed"] for r in rows] == [True, True] + [False] * 6 + [True]
    assert [r["cpu"] for r in rows[2:8]] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert [r["state"] for r in rows[2:8]] == ["idle", "idle", "backup", "backup", "idle", "idle"]
    assert [r["smoothed"] for r in rows[2:4]] == [0.0, 0.5] and rows[0]["cpu"] is None


def test_operations_and_scalability(spark):
    t = datetime(2026, 6, 20, 1, 2)
    log = spark.createDataFrame(
        [(t, "CREATE"), (t, "CREATE"), (t + timedelta(minutes=14), "CREATE"), (t + timedelta(minutes=5), "READ"), (t, None),
         (t + timedelta(hours=9), "READ")],
        "ts timestamp_ntz, action string",
    )
    cut = F.lit(t + timedelta(hours=1))
    shares = reports.operation_distribution(log, cut).collect()
    assert [(r["action"], r["n"], r["total"], r["pct"]) for r in shares] == [("CREATE", 3, 4, 75.0), ("READ", 1, 4, 25.0)]
    wide = [tuple(r)[1:] for r in reports.operation_rate(log, cut, ["CREATE", "READ"]).orderBy("bucket").collect()]
    assert wide == [(2, 0), (0, 1), (0, 0), (1, 0)]
    cycles = spark.createDataFrame(
        [("v1", "cycle-1", 1542621165, 70.02, 48.43), ("v1", "cycle-2", 386382531, 13.4, 31.06)], "chain string, cycle string, raw_size bigint, time double, rate double"
    )
    rows = reports.scalability(cycles).orderBy("cycle").collect()
    assert rows[1]["cumulative_gib"] == pytest.approx((1542621165 + 386382531) / 1024**3)
    assert [r["is_slow"] for r in rows] == [True, False]
