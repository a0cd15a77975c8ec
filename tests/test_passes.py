"""Listings, reads by range, files put together, and backup passes over polls."""

import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cycle_analytics.functions import crypto
from cycle_analytics.operators import ledger
from cycle_analytics.sources import listing, packages, sinks
from cycle_analytics.streaming import passes
from tests.test_sources import package, write

KEY = bytes(range(32))


def test_listing_parts_and_digests(spark, tmp_path):
    data = os.urandom(10_000)
    write(tmp_path / "in" / "v1" / "c1" / "d" / "a.bin", data)
    write(tmp_path / "in" / "v1" / "c1" / "empty", b"")
    write(tmp_path / "in" / "v1" / ".hidden" / "x", b"x")
    write(tmp_path / "in" / "top.txt", b"one\ntwo\n\nno end")
    found = listing.listed(spark, str(tmp_path / "in"))
    rows = {r.path.split("/in/")[1]: r for r in found.collect()}
    assert {n: r.bytes for n, r in rows.items()} == {"v1/c1/d/a.bin": 10_000, "v1/c1/empty": 0, "top.txt": 15}
    digests = {r.path.split("/in/")[1]: r.actual_sha256 for r in listing.file_digests(found, 777).collect()}
    assert digests["v1/c1/d/a.bin"] == hashlib.sha256(data).hexdigest()
    parts = listing.file_parts(found, 999)
    got = sorted((r.chunk_no, bytes(r.chunk)) for r in parts.where("path LIKE '%a.bin'").collect())
    assert len(got) == 11 and b"".join(c for _, c in got) == data
    sums = [hashlib.sha256(c).hexdigest() for _, c in got]
    for up in (3, 3, 99):
        sums = [hashlib.sha256("".join(sums[k : k + up]).encode()).hexdigest() for k in range(0, len(sums), up)]
    told = listing.part_list_digest(parts, ["path"], fan_out=3).where("path LIKE '%a.bin'").first()
    assert (told.n_parts, told.bytes, told.parts_sha256) == (11, 10_000, sums[0])
    lines = listing.file_lines(found.where("path LIKE '%.txt'")).collect()
    assert [r.value for r in lines] == ["one", "two", "", "no end"]
    assert listing.listed(spark, str(tmp_path / "absent")).count() == 0


def test_lost_and_shortened_files(spark, tmp_path):
    for name in "abc":
        write(tmp_path / "in" / f"{name}.bin", b"0123456789")
    found = spark.createDataFrame(listing.listed(spark, str(tmp_path / "in")).collect(), listing.LISTING)
    os.remove(tmp_path / "in" / "a.bin")
    write(tmp_path / "in" / "b.bin", b"01234")
    parts = listing.file_parts(found, 4).groupBy("path").agg(F.sum(F.length("chunk")).alias("n")).collect()
    assert sorted((r.path[-5], r.n) for r in parts) == [("b", 5), ("c", 10)]
    assert sorted((r.path[-5], r.read_bytes) for r in listing.file_digests(found).collect()) == [("b", 5), ("c", 10)]


def test_files_are_put_together_in_order(spark, tmp_path):
    rows = [("d/x", k, bytes([k]) * 3) for k in range(50)] + [("y", 0, None), ("d/e/z", 2, b"b"), ("d/e/z", 1, b"a")]
    out = str(tmp_path / "out")
    chunks = spark.createDataFrame(rows, "path string, chunk_no int, chunk binary").repartition(7)
    for _ in range(2):
        done = {r.path: (r.bytes, r.sha256) for r in sinks.assembled_files(chunks, out).collect()}
        whole = b"".join(bytes([k]) * 3 for k in range(50))
        assert done["d/x"] == (150, hashlib.sha256(whole).hexdigest()) and done["y"][0] == 0
        left = sorted(str(p.relative_to(out)) for p in (tmp_path / "out").rglob("*") if p.is_file())
        assert left == ["d/e/z", "d/x", "y"] and (tmp_path / "out" / "d" / "x").read_bytes() == whole
        assert (tmp_path / "out" / "d" / "e" / "z").read_bytes() == b"ab"


def test_small_files_are_written_and_read_by_many_tasks(spark, tmp_path):
    chunks = spark.range(40).select(
        F.concat(F.lit("in/"), F.col("id").cast("string"), F.when(F.col("id") % 4 == 0, ".done").otherwise(".json")).alias("path"),
        F.lit(0).alias("chunk_no"), F.col("id").cast("string").cast("binary").alias("chunk"),
    )
    made = sinks.assembled_files(chunks, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(made) == 40 and len({r.task for r in made}) > 1
    write(tmp_path / "in" / "1.done", b"ok")
    write(tmp_path / "in" / "deeper" / "99.json", b"99")
    folder = str(tmp_path / "in")
    left = {str(k): str(k) for k in range(40) if k % 4 and k != 1}
    assert {r.request_id: r.body for r in packages.open_requests(spark, folder).collect()} == left
    batch = packages.request_documents(spark, folder)
    # The driver holds no list of the request files.
    assert batch.count() == 30 and not [p for p in batch.inputFiles() if p.endswith(".json")]
    assert listing.ListedFiles({"path": folder, "deep": "false"}).reader(None).partitions() == [listing.Folder(folder, False)]


def test_packages_are_read_without_a_list_on_the_driver(spark, tmp_path):
    for name, data in (("a.txt", b"a" * 3000), (packages.CHECKSUM_FILE, hashlib.sha256(b"a" * 3000).hexdigest().encode() + b"  a.txt\r\n")):
        write(tmp_path / "v1" / "c1" / name, data)
    found, lists = packages.digested_files(spark, str(tmp_path)), packages.checksum_lists(spark, str(tmp_path))
    assert {r.rel_path: r.bytes for r in found.collect()} == {"a.txt": 3000, packages.CHECKSUM_FILE: 73}
    expected = {r.rel_path: r.expected_sha256 for r in lists.collect()}
    assert expected == {"a.txt": hashlib.sha256(b"a" * 3000).hexdigest()}
    assert {r.actual_sha256 for r in found.where("rel_path = 'a.txt'").collect()} == set(expected.values())
    assert not [p for df in (found, lists) for p in df.inputFiles() if "/v1/" in p]


@pytest.fixture
def polls(spark, tmp_path):
    store, ring = passes.new_store(spark, str(tmp_path / "store")), crypto.key_ring(spark, key=KEY)

    def poll(targets=None):
        query = passes.polled_backup(spark, str(tmp_path / "in"), store, ring, targets or {}, once=True, chunk_bytes=4)
        query.awaitTermination(240)
        assert query.exception() is None
        last = store.newest("ledger", 1 << 31)
        return sorted((r.chain_v, r.cycle_id, r.stage, r.target) for r in store.only("ledger", last).collect())

    return store, poll


def test_a_rewritten_file_is_taken_again_and_an_empty_poll_retries(spark, tmp_path, polls):
    store, poll = polls
    package(tmp_path / "in", "v1", "c1", {"a.bin": b"aaaaaaaaa"})
    package(tmp_path / "in", "v1", "c2", {"b.bin": b"bbbb"}, alter={"b.bin"})
    (tmp_path / "wall").write_bytes(b"")
    good, bad = {"t": str(tmp_path / "t")}, {"t": str(tmp_path / "wall" / "t")}
    assert poll(bad) == [("v1", "c1", "stored", None)]
    write(tmp_path / "in" / "v1" / "c2" / "b.bin", b"bbbb")
    assert poll(bad) == [("v1", "c2", "stored", None)]
    taken = [r.path.rsplit("/", 1)[1] for r in store.only("taken", 1).collect()]
    assert taken == ["b.bin"]  # nothing else was read again
    assert poll(good) == [("v1", c, s, t) for c in ("c1", "c2") for s, t in (("done", None), ("uploaded", "t"))]
    assert poll(good) == []
    sent = passes.target_table(spark, good["t"], "artifacts")
    assert sent.count() == store.read("artifacts").count() == sent.select(*passes.IDENTITY).distinct().count()
    retire = passes.plaintext_to_retire(store).select(*passes.KEY).distinct().collect()
    assert sorted(map(tuple, retire)) == [("v1", "c1"), ("v1", "c2")]


def test_a_corrected_list_counts_as_a_whole(spark, tmp_path, polls):
    store, poll = polls
    lost = hashlib.sha256(b"lost").hexdigest()
    package(tmp_path / "in", "v1", "c1", {"a.bin": b"a"}, extra_lines=[f"{lost}  never.bin"])
    assert poll() == []
    assert store.only("open_lists", 0).count() > 0
    package(tmp_path / "in", "v1", "c1", {"a.bin": b"a"})
    assert [r[2] for r in poll()] == ["done", "stored"]
    assert store.only("open_files", 1).count() == store.only("open_lists", 1).count() == 0


def test_a_half_sent_target_holds_every_row_once(spark, tmp_path, polls, monkeypatch):
    store, poll = polls
    package(tmp_path / "in", "v1", "c1", {"a.bin": b"aaaaaaaaa"})
    uri = str(tmp_path / "t")
    monkeypatch.setattr(passes, "SENT", ("artifacts", "sealed"))
    monkeypatch.setattr(ledger, "upload_backlog", ledger.upload_backlog)
    real = passes.replicate
    monkeypatch.setattr(passes, "replicate", lambda *a: real(*a) and False)  # stops before the catalog row
    poll({"t": uri})
    monkeypatch.undo()
    assert [r[2] for r in poll({"t": uri})] == ["done", "uploaded"]
    for name in ("artifacts", "sealed", "catalog"):
        assert passes.target_table(spark, uri, name).count() == store.read(name).count()


def test_manifest_reaches_the_catalog(spark, tmp_path, polls):
    store, poll = polls
    package(tmp_path / "in", "v1", "c1", {"a.bin": b"a"})
    poll()
    row = store.read("catalog").first()
    assert row.n_files == 3 and row.manifest_summary is not None


def test_many_small_files_are_told_and_read_in_few_batches(tmp_path):
    n, base = 3 * listing.BATCH_ROWS // 2, str(tmp_path)
    names = [f"c/{k:05}.txt" for k in range(n)]
    rows = pa.RecordBatch.from_pydict({"path": names + names[-1:], "no": [0] * n + [1], "chunk": [b"%d" % k for k in range(n)] + [b"!"]})
    told = list(sinks.put_together(iter([rows.slice(0, 100), rows.slice(100)]), base))
    assert [batch.num_rows for batch in told] == [listing.BATCH_ROWS, n - listing.BATCH_ROWS]
    table = pa.Table.from_batches(told).to_pydict()
    assert table["path"] == names and table["bytes"][-1] == len(b"%d" % (n - 1)) + 1 and list(sinks.put_together(iter([]), base)) == []
    assert table["sha256"][7] == hashlib.sha256(b"7").hexdigest() and (tmp_path / names[-1]).read_bytes() == b"%d!" % (n - 1)

    places = [f"{base}/{name}" for name in names]
    asked = pa.RecordBatch.from_pydict({"path": [*places, f"{base}/gone"], "begin": [0] * (n + 1), "size": [1] * (n + 1)})
    (read,) = listing.read_ranges(iter([asked]), ["path", "begin"])
    assert read.column("path").to_pylist() == places and read.column("chunk").to_pylist() == [b"%d" % (k // 10 ** (len(str(k)) - 1)) for k in range(n)]
    with open(f"{base}/large", "wb") as file:
        file.write(b"x" * 5 * listing.BLOCK_BYTES)
    size = listing.BLOCK_BYTES
    asked = pa.RecordBatch.from_pydict({"path": [f"{base}/large"] * 5, "begin": [k * size for k in range(5)], "size": [size] * 5})
    assert [batch.num_rows for batch in listing.read_ranges(iter([asked]), ["path", "begin"])] == [1] * 5
