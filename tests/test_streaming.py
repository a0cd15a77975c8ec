"""Backup and restore passes, listener and request outcomes on real file streams."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cycle_analytics.functions import crypto
from cycle_analytics.operators import ledger
from cycle_analytics.operators import chunks
from cycle_analytics.plans.restore import (
    file_verdicts, integrity_report, opened_packages, package_verdicts, restore_pass, restore_plan,
)
from cycle_analytics.sources import packages, telemetry
from cycle_analytics.streaming import listener, passes, samples, states
from cycle_analytics.streaming.store import Store
from tests.test_sources import package, write

KEY = bytes(range(32))


def run(query):
    query.awaitTermination(240)
    assert query.exception() is None


@pytest.fixture(scope="module")
def backed_up(spark, tmp_path_factory):
    """Two passes: the second brings the file that one package lacked."""
    base = tmp_path_factory.mktemp("backup")
    incoming, store_root = base / "incoming", str(base / "store")
    package(incoming, "chain-v1", "c1", {"a.bin": b"aaaa", "d/b.bin": b"0123456789"})
    late = hashlib.sha256(b"late").hexdigest()
    package(incoming, "chain-v1", "c2", {"x.bin": b"x"}, extra_lines=[f"{late}  late.bin"])
    package(incoming, "chain-v2", "c1", {"z.bin": b"z"}, alter={"z.bin"})
    store = passes.new_store(spark, store_root)
    ring = crypto.key_ring(spark, key=KEY)
    targets = {"general": f"{base}/general"}

    def once():
        run(passes.backup_stream(passes.incoming_stream(spark, str(incoming)), store, ring, targets, once=True, chunk_bytes=4))

    once()
    after_first = ledger.stages(store.read("ledger")).collect()
    write(incoming / "chain-v1" / "c2" / "late.bin", b"late")
    once()
    once()
    return store, after_first, targets, ring


def test_unready_packages_are_taken_up_later(backed_up):
    store, after_first, targets, _ = backed_up
    assert sorted((r["cycle_id"], r["stage"], r["target"]) for r in after_first) == [
        ("c1", "done", None), ("c1", "stored", None), ("c1", "uploaded", "general"),
    ]
    rows = store.read("ledger").collect()
    assert len(rows) == 6 and {r["cycle_id"] for r in rows if r["chain_v"] == "chain-v1"} == {"c1", "c2"}
    sent = store.spark.read.schema(passes.TABLES["artifacts"]).parquet(f"{targets['general']}/artifacts")
    assert sent.count() == store.read("artifacts").count()
    assert store.read("telemetry").count() == 2


def test_a_repeated_batch_changes_nothing(spark, backed_up):
    store, _, targets, ring = backed_up
    before = sorted(map(str, store.read("ledger").drop("at").collect()))
    files = spark.createDataFrame([], "chain_v string, cycle_id string, rel_path string, content binary")
    last = store.read("ledger").agg(F.max("batch")).first()[0] + 1
    for _ in range(2):
        passes.run_pass(store, files, last, ring, targets)
    assert sorted(map(str, store.read("ledger").drop("at").collect())) == before


def test_a_failing_target_is_retried_without_encrypting_again(spark, tmp_path, monkeypatch):
    package(tmp_path / "in", "v", "c", {"a": b"a"})
    store = passes.new_store(spark, str(tmp_path / "store"))
    ring = crypto.key_ring(spark, key=KEY)
    files = packages.files(spark, str(tmp_path / "in")).select("chain_v", "cycle_id", "rel_path", "content")
    targets = {"general": str(tmp_path / "general"), "immutable": str(tmp_path / "immutable")}
    real = passes.replicate
    monkeypatch.setattr(passes, "replicate", lambda s, name, uri, b: name != "immutable" and real(s, name, uri, b))
    passes.run_pass(store, files, 0, ring, targets)
    assert {(r["stage"], r["target"]) for r in store.read("ledger").collect()} == {("stored", None), ("uploaded", "general")}
    sealed = store.read("artifacts").count()
    monkeypatch.setattr(passes, "replicate", real)
    passes.run_pass(store, files.limit(0), 1, ring, targets)
    second = store.only("ledger", 1).collect()
    assert {(r["stage"], r["target"], r["reused"]) for r in second} == {("uploaded", "immutable", False), ("done", None, True)}
    assert store.read("artifacts").count() == sealed


def test_restore_pass_delivers_the_ok_prefix_only(spark, backed_up, tmp_path):
    store, _, _, ring = backed_up
    catalog = store.read("catalog").select("chain_v", "cycle_id")
    requests = spark.createDataFrame([("r1", "chain-v1", 5), ("r2", "chain-v9", 1)], "request_id string, version string, chain_n bigint")
    plan = restore_plan(requests, catalog)
    assert [(r["cycle_id"], r["replay_order"], r["available"], r["selected"]) for r in plan.orderBy("replay_order").collect()] == [("c1", 1, 2, 2), ("c2", 2, 2, 2)]
    artifacts = store.read("artifacts").drop("batch")
    judged = restore_pass(plan, artifacts, ring, str(tmp_path / "out"), str(tmp_path / "wf"), store.read("sealed"))
    assert all(r["prefix_ok"] for r in judged.collect())
    staged = spark.read.parquet(str(tmp_path / "out")).where("rel_path = 'd/b.bin'").orderBy("chunk_no").collect()
    assert b"".join(bytes(r["content"]) for r in staged) == b"0123456789"
    assert telemetry.workflow_telemetry(spark, str(tmp_path / "wf")).where("workflow_type = 'restore'").count() == 2

    broken = artifacts.withColumn("artifact", F.when((F.col("cycle_id") == "c1") & (F.col("chunk_no") == 1), F.lit(b"x" * 40)).otherwise(F.col("artifact")))
    verdicts = restore_pass(plan, broken, ring, str(tmp_path / "out2"), str(tmp_path / "wf2"), store.read("sealed")).orderBy("replay_order").collect()
    assert [(r["ok"], r["prefix_ok"]) for r in verdicts] == [(False, False), (True, False)]


@pytest.mark.parametrize("lost, status", [
    ("cycle_id = 'c1' AND rel_path = 'd/b.bin' AND chunk_no = 1", "incomplete"),
    ("cycle_id = 'c1' AND rel_path = 'd/b.bin' AND chunk_no = 2", "incomplete"),
    ("cycle_id = 'c1' AND rel_path = 'd/b.bin'", "missing"),
    ("cycle_id = 'c1'", "missing"),
])
def test_a_loss_fails_the_cycle_and_what_follows(spark, backed_up, tmp_path, lost, status):
    store, _, _, ring = backed_up
    sealed = store.read("sealed")
    requests = spark.createDataFrame([("r1", "chain-v1", 5)], "request_id string, version string, chain_n bigint")
    plan = restore_plan(requests, store.read("catalog").select("chain_v", "cycle_id"))
    left = store.read("artifacts").drop("batch").where(f"NOT ({lost})")
    judged = restore_pass(plan, left, ring, str(tmp_path / "out"), str(tmp_path / "wf"), sealed)
    assert [(r["cycle_id"], r["ok"], r["prefix_ok"]) for r in judged.orderBy("replay_order").collect()] == [
        ("c1", False, False), ("c2", True, False),
    ]
    files = file_verdicts(opened_packages(plan, left, ring), sealed)
    found = {r["rel_path"]: r["status"] for r in files.where("cycle_id = 'c1'").collect()}
    assert found["d/b.bin"] == status
    assert found["a.bin"] == ("missing" if lost == "cycle_id = 'c1'" else "ok")


def test_doubled_chunks_are_whole_and_unlisted_files_are_not(spark, backed_up):
    store, _, _, ring = backed_up
    plan = store.read("catalog").select(F.col("chain_v").alias("version"), "cycle_id")
    artifacts = store.read("artifacts").drop("batch")
    twice = package_verdicts(opened_packages(plan, artifacts.unionAll(artifacts), ring), store.read("sealed"))
    once = package_verdicts(opened_packages(plan, artifacts, ring), store.read("sealed"))
    assert sorted(twice.collect()) == sorted(once.collect()) and all(r["ok"] for r in once.collect())
    fewer = store.read("sealed").where("rel_path <> 'a.bin'")
    verdicts = package_verdicts(opened_packages(plan, artifacts, ring), fewer)
    assert {r["cycle_id"]: r["ok"] for r in verdicts.collect()} == {"c1": False, "c2": True}


def test_integrity_report(spark, backed_up):
    store, _, _, ring = backed_up
    catalog, artifacts = store.read("catalog").drop("batch"), store.read("artifacts").drop("batch")
    plan = catalog.select(F.col("chain_v").alias("version"), "cycle_id")
    verdicts = package_verdicts(opened_packages(plan, artifacts, ring), store.read("sealed"))
    report = integrity_report(artifacts, verdicts, catalog, ledger.finished(store.read("ledger")))
    assert [(r["cycle_id"], r["passed"]) for r in report.orderBy("cycle_id").collect()] == [("c1", True), ("c2", True)]
    unmarked = integrity_report(artifacts, verdicts, catalog, ledger.finished(store.read("ledger")).where("cycle_id = 'c1'"))
    assert {r["cycle_id"]: r["passed"] for r in unmarked.collect()} == {"c1": True, "c2": False}


def test_chunks_of_a_chain_are_stored_once_and_replayed(spark):
    files = spark.createDataFrame(
        [("v", 1, "f", bytearray(b"aaaabbbb")), ("v", 2, "f", bytearray(b"aaaacccc")), ("v", 2, "g", bytearray(b""))],
        "chain_v string, cycle int, rel_path string, content binary",
    )
    pieces = chunks.with_digest(chunks.chunked(files, "content", 4))
    assert pieces.count() == 5
    fresh = chunks.new_chunks(pieces.where("cycle = 2"), pieces.where("cycle = 1"), ["chain_v"])
    assert sorted((r["rel_path"], bytes(r["chunk"])) for r in fresh.collect()) == [("f", b"cccc"), ("g", b"")]
    newest = chunks.latest_chunks(pieces, ["chain_v", "rel_path", "chunk_no"], "cycle", ["chunk"])
    assert [bytes(r["chunk"]) for r in newest.where("rel_path = 'f'").orderBy("chunk_no").collect()] == [b"aaaa", b"cccc"]


def test_request_listener(spark, tmp_path):
    folder = tmp_path / "requests"
    write(folder / "r1.json", json.dumps({"version": "chain-v1", "chain": 2}, indent=2))
    write(folder / "r2.json", json.dumps({"version": "chain-v1", "chain": 0}))
    write(folder / "r3.json", "{broken")
    store = listener.new_store(spark, str(tmp_path / "store"))
    run(listener.listen(listener.request_stream(spark, str(folder)), store, "/in", once=True))
    write(folder / "r4.json", json.dumps({"version": "chain-v2", "chain": 1, "source": "general"}))
    run(listener.listen(listener.request_stream(spark, str(folder)), store, "/in", once=True))
    assert {r["request_id"] for r in listener.accepted(store).collect()} == {"r1", "r4"}
    assert {tuple(r) for r in listener.refused(store).collect()} == {("r2", "chain_below_one"), ("r3", "parse_error")}
    write(folder / "r1.done", "ok")
    batch = packages.request_documents(spark, str(folder))
    from cycle_analytics.operators.requests import unclaimed
    assert {r["request_id"] for r in unclaimed(batch, packages.done_markers(spark, str(folder))).collect()} == {"r2", "r3", "r4"}


def test_sample_windows_over_two_batches(spark, tmp_path):
    t = datetime(2026, 6, 20, 1, 0)
    folder = str(tmp_path / "in")
    schema = {"w": "bucket timestamp_ntz, host string, n bigint, max_value double, sum_value double"}
    store = Store(spark, str(tmp_path / "store"), schema).create()
    for minutes in ((0, 1, 6), (2, 7, -600)):  # the last one is ten hours late
        spark.createDataFrame([(t + timedelta(minutes=m), "h", float(m)) for m in minutes], "ts timestamp_ntz, host string, v double").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ts timestamp_ntz, host string, v double").parquet(folder)
        run(samples.collect_updates(samples.window_stats(stream, "ts", ["host"], "v", 5), store, "w"))
    rows = samples.current_windows(store, "w", ["host"]).orderBy("bucket").collect()
    assert [(r["n"], r["max_value"], r["sum_value"]) for r in rows] == [(1, -600.0, -600.0), (3, 2.0, 3.0), (2, 7.0, 13.0)]


def test_request_outcomes(spark, tmp_path):
    t = datetime(2026, 6, 20, 1, 0)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame([(i, s, t + timedelta(seconds=n)) for i, s, n in rows], "request_id string, state string, at timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("request_id string, state string, at timestamp").parquet(folder)
        writer = states.outcomes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        run(writer.trigger(availableNow=True).start())

    arrive([("a", "pending", 0), ("b", "pending", 0), ("c", "pending", 0)])
    arrive([("a", "inprogress", 5), ("a", "done", 60), ("b", "error", 299), ("d", "pending", 100)])
    arrive([("e", "pending", 1000)])
    arrive([("e", "done", 1301), ("c", "done", 1310), ("a", "pending", 1311)])  # closed requests stay closed
    arrive([("f", "error", 5000), ("f", "done", 5000), ("f", "pending", 4990)])
    arrive([("g", "pending", 9000)])
    rows = sorted((r["request_id"], r["outcome"], r["waited_s"]) for r in spark.read.parquet(out).collect())
    assert rows == [
        ("a", "done", 60.0), ("b", "error", 299.0), ("c", "timeout", 300.0), ("d", "timeout", 300.0), ("e", "timeout", 300.0),
        ("f", "done", 10.0),
    ]


def test_outcomes_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    t = datetime(2026, 6, 20, 1, 0)
    events = [("a", "pending", 0), ("a", "done", 299), ("b", "error", 20), ("b", "pending", 5), ("b", "done", 30), ("c", "done", 301), ("c", "pending", 1)]
    found = []
    for turn, batches in enumerate(([events], [[e] for e in events], [[e] for e in reversed(events)])):
        folder, out = str(tmp_path / f"in{turn}"), str(tmp_path / f"out{turn}")
        for batch in [*batches, [("z", "pending", 90_000)]]:
            rows = [(i, s, t + timedelta(seconds=n)) for i, s, n in batch]
            spark.createDataFrame(rows, "request_id string, state string, at timestamp").write.mode("append").parquet(folder)
            stream = spark.readStream.schema("request_id string, state string, at timestamp").parquet(folder)
            writer = states.outcomes(stream, lateness="1 hour").writeStream.format("parquet").option("path", out)
            run(writer.option("checkpointLocation", str(tmp_path / f"cp{turn}")).trigger(availableNow=True).start())
        found.append(sorted(map(tuple, spark.read.schema(states.OUTCOME).parquet(out).collect())))
    assert found == [[("a", "done", 299.0), ("b", "error", 15.0), ("c", "timeout", 300.0)]] * 3
