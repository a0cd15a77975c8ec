"""Hash trees, history filters, mirrors and replicas on small cases with known answers."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from cycle_analytics.operators.hash_tree import HashTree, compared
from cycle_analytics.operators.history import ChunkHistory
from cycle_analytics.plans import replicas
from cycle_analytics.sources import listing
from cycle_analytics.sources.mirror import IncompleteMirror, Mirror

CHUNKS = "chain_v string, cycle_id string, rel_path string, chunk_no int, chunk_sha256 string, bytes bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chunk_rows(spark, files):
    """Chunk rows of {(chain, cycle, path): text}, one character a chunk."""
    rows = [(*k, n, sha(c), 1) for k, t in files.items() for n, c in enumerate(t or " ")]
    return spark.createDataFrame(rows, CHUNKS)


def test_trees_tell_what_happened_to_files(spark, tmp_path):
    left = {("v", "c1", "a"): "abc", ("v", "c1", "b"): "bcd", ("v", "c2", "x"): "xyz", ("v", "c2", "t1"): "tt", ("v", "c2", "t2"): "tt", ("w", "c1", "a"): "abc"}
    right = {("v", "c1", "a"): "acb", ("v", "c1", "b"): "bcd", ("v", "c3", "x2"): "xyz", ("v", "c2", "t3"): "tt", ("v", "c2", "n"): "new", ("w", "c1", "a"): "abc"}
    trees = [HashTree(spark, str(tmp_path / n)).add(chunk_rows(spark, f)) for n, f in (("l", left), ("r", right))]
    got = {(r.cycle_id, r.rel_path): (r.status, r.other_path) for r in compared(*trees).collect()}
    assert got == {
        ("c1", "a"): ("altered", None), ("c2", "x"): ("renamed", "c3/x2"), ("c2", "t1"): ("lost", None), ("c2", "t2"): ("lost", None),
        ("c2", "t3"): ("extra", None), ("c2", "n"): ("extra", None),
    }
    assert compared(trees[0], trees[0]).count() == 0


def test_a_tree_can_be_added_to(spark, tmp_path):
    files = {("v", f"c{k}", f"f{j}"): f"{k}{j}" for k in range(3) for j in range(4)}
    whole = HashTree(spark, str(tmp_path / "whole")).add(chunk_rows(spark, files))
    grown = HashTree(spark, str(tmp_path / "grown"))
    for cycle in ("c2", "c0", "c1", "c1"):
        grown.add(chunk_rows(spark, {k: t for k, t in files.items() if k[1] == cycle}))
    for level in ("files", "cycles", "chains"):
        assert sorted(grown.level(level).collect()) == sorted(whole.level(level).collect())


def test_equal_cycles_are_not_read(spark, tmp_path):
    files = {("v", f"c{k:02}", f"f{j}"): f"{k}-{j}" for k in range(20) for j in range(5)}
    trees = [HashTree(spark, str(tmp_path / "l")).add(chunk_rows(spark, files))]
    trees.append(HashTree(spark, str(tmp_path / "r")).add(chunk_rows(spark, {**files, ("v", "c07", "f1"): "else"})))
    found = compared(*trees)
    assert [(r.cycle_id, r.rel_path, r.status) for r in found.collect()] == [("c07", "f1", "altered")]
    from cycle_analytics.operators import hash_tree

    below = hash_tree.differing_files(*trees)
    assert "dynamicpruning" in below._jdf.queryExecution().toString()


def test_history_filter_has_no_false_absence_and_spares_the_history(spark, tmp_path):
    def digests(chain, numbers):
        return spark.createDataFrame([(chain, sha(f"{chain}{n}")) for n in numbers], "chain_v string, chunk_sha256 string")

    history = ChunkHistory(spark, str(tmp_path / "h"), blocks=4, shard_digits=1)
    for batch in range(3):
        history.add(digests("v", range(1000 * batch, 1000 * batch + 1000)).unionByName(digests("w", range(50))), batch)
    history.add(digests("v", range(2000, 3000)).unionByName(digests("w", range(50))), 2)  # again
    new = digests("v", range(2500, 6000)).unionByName(digests("w", range(40, 60))).unionByName(digests("u", range(9)))
    maybe = history.candidates(new)
    assert 510 <= maybe.count() < 600
    want = {("v", sha(f"v{n}")) for n in range(2500, 3000)} | {("w", sha(f"w{n}")) for n in range(40, 50)}
    assert {tuple(r) for r in history.known(new).collect()} == want
    few = history.candidates(digests("v", [7, 9_000_001]))
    assert history.looked_up(few).count() < history.digests().count() / 5
    larger = history.rebuilt(str(tmp_path / "h2"), 64)
    assert {tuple(r) for r in larger.known(new).collect()} == want
    narrow = history.rebuilt(str(tmp_path / "h3"), 1).add(digests("v", range(9000, 40_000)), 1)  # filled beyond its size
    assert {tuple(r) for r in narrow.known(digests("v", [1, 39_999, 50_000])).collect()} == {("v", sha("v1")), ("v", sha("v39999"))}


def texts(spark, files):
    rows = spark.createDataFrame([(p, 0, t.encode()) for p, t in files.items()], "path string, chunk_no int, chunk binary")
    return rows.select("path", F.length("chunk").cast("bigint").alias("bytes"), F.sha2("chunk", 256).alias("sha256")), rows


def contents(mirror):
    return {r.path: bytes(r.chunk).decode() for r in mirror.contents(1000).collect()}


def test_mirror_changes_as_a_whole(spark, tmp_path):
    mirror = Mirror(spark, str(tmp_path / "m"))
    assert mirror.version() is None and mirror.manifest().count() == 0
    one, two = {"a/x": "ax", "b": "bb", "c": ""}, {"a/x": "ax", "b": "other", "d": "dd"}
    mirror.prepare("1", *texts(spark, one))
    assert contents(mirror) == {}
    mirror.publish("1")
    assert contents(mirror) == one
    mirror.prepare("2", *texts(spark, two))
    assert contents(mirror) == one
    for _ in range(2):
        mirror.publish("2")
        assert contents(mirror) == two
    stay = {r.path: r.place for r in mirror.manifest().collect()}
    assert "/data/1/" in stay["a/x"] and "/data/2/" in stay["b"]
    unused = mirror.unreferenced(listing.listed(spark, str(tmp_path / "m" / "data")))
    assert sorted(r.path.split("/data/")[1] for r in unused.collect()) == ["1/b", "1/c"]


def test_a_mirror_that_is_not_whole_cannot_be_published(spark, tmp_path):
    mirror = Mirror(spark, str(tmp_path / "m"))
    files, rows = texts(spark, {"a": "a", "b": "b"})
    with pytest.raises(IncompleteMirror):
        mirror.prepare("1", files, rows.where("path = 'a'"))
    with pytest.raises(IncompleteMirror):
        mirror.publish("1")
    assert mirror.version() is None and not os.path.exists(tmp_path / "m" / "current")


def test_sources_fall_back_to_dearer_ones(spark):
    named = {name: spark.range(1) for name in replicas.SOURCES}
    assert list(replicas.allowed(named, "general")) == ["general", "immutable"]
    judged = spark.createDataFrame(
        [("v", "c", "f", 0, "local", 0, False), ("v", "c", "f", 0, "general", 1, True), ("v", "c", "f", 0, "immutable", 2, True), ("v", "c", "f", 1, "local", 0, False)],
        "chain_v string, cycle_id string, rel_path string, chunk_no int, replica string, cost int, whole boolean",
    )
    choice = replicas.chosen(judged)
    assert [(r.chunk_no, r.replica) for r in choice.collect()] == [(0, "general")]
    due = replicas.due_chunks(spark.createDataFrame([("v", "c", "f", 2)], "chain_v string, cycle_id string, rel_path string, n_chunks bigint"))
    plan = replicas.healing_plan(due, judged, choice, list(replicas.SOURCES)).collect()
    assert [(r.chunk_no, r.replica, r.target) for r in plan] == [(0, "general", "local")]
    assert [r.ok for r in replicas.whole_cycles(due, choice).collect()] == [False]
