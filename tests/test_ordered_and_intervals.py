"""Both ways of the ordered and interval operators against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cycle_analytics.operators import ordered, sequence
from cycle_analytics.operators.asof import asof_peak, latest_before, state_label
from cycle_analytics.operators.intervals import _extent, _within, span_stats, window_peak_after
from cycle_analytics.operators.ordered import block_count, number, peak, previous, running, total
from cycle_analytics.operators.sequence import counter_rate, oldest_n, prefix_ok, replay_prefix

T0 = datetime(2026, 6, 20, 23, 0, 0)


def _skewed_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.1 else rng.randint(-50, 50)
        rows.append((key, rng.randint(0, 200), i, value))
    return rows


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_values_agree_with_brute_force(spark, keys):
    rows = _skewed_rows()
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    measures = {
        "n": number(), "s": total(F.col("v")), "m": peak(F.col("v")), "p": previous(F.col("v")),
    }
    expected = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[0] if keys else 0, []).append(row)
    for members in groups.values():
        s = m = p = None
        for n, (k, t, i, v) in enumerate(sorted(members, key=lambda r: (r[1], r[2])), 1):
            if v is not None:
                s = v if s is None else s + v
                m = v if m is None else max(m, v)
            expected[i] = (n, s, m, p)
            p = v
    for split in (False, True):
        got = running(df, keys, ["t", "id"], measures, hot_rows=100, split=split)
        assert {r["id"]: (r["n"], r["s"], r["m"], r["p"]) for r in got.collect()} == expected


def test_blocks_follow_what_is_read_not_the_product_of_joins(spark):
    rows = spark.range(1_000_000)
    joined = rows.join(rows.withColumn("v", F.col("id") * 2), "id")
    assert block_count(joined) == block_count(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_spans_are_cut_only_where_samples_are(spark):
    ranges = spark.createDataFrame([(1, 0, 50), (2, 90, 120), (3, 100, 900), (4, 201, 300)], "_span int, _lo bigint, _hi bigint")
    points = spark.createDataFrame([(100, 1.0), (200, 2.0)], "_t bigint, _v double")
    kept = _within(ranges, _extent(points, []))
    assert sorted(tuple(r) for r in kept.collect()) == [(2, 100, 120), (3, 100, 201)]
    assert _within(ranges, _extent(points.limit(0), [])).count() == 0


@pytest.mark.parametrize("split,bucket_rows", [(False, 10), (True, 5)])
@pytest.mark.parametrize("closed", [True, False])
def test_span_stats_agree_with_brute_force(spark, split, bucket_rows, closed):
    rng = random.Random(11)
    spans, samples = [], []
    for i in range(60):
        lo = T0 + timedelta(seconds=rng.randint(0, 4000))
        hi = lo + timedelta(seconds=rng.choice([0, 1, 30, 500, 20_000]))
        spans.append((i, rng.choice(["p", "r"]), lo, hi))
    for i in range(300):
        at = T0 + timedelta(seconds=rng.choice([1000, 1001, rng.randint(0, 9000)]))
        samples.append((rng.choice(["p", "r"]), at, None if rng.random() < 0.05 else float(rng.randint(0, 99))))
    span_df = spark.createDataFrame(spans, "id int, host string, lo timestamp_ntz, hi timestamp_ntz")
    sample_df = spark.createDataFrame(samples, "host string, ts timestamp_ntz, v double")
    got = span_stats(
        span_df, sample_df, "id", F.col("lo"), F.col("hi"), "ts", "v", ["host"],
        closed=closed, width_seconds=4, bucket_rows=bucket_rows, split=split,
    )
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == len(spans)
    for i, host, lo, hi in spans:
        inside = [
            v for h, t, v in samples
            if h == host and v is not None and (lo <= t <= hi if closed else lo < t < hi)
        ]
        assert rows[i]["n_samples"] == len(inside)
        assert rows[i]["max_value"] == (max(inside) if inside else None)
        if inside:
            assert rows[i]["avg_value"] == pytest.approx(sum(inside) / len(inside))


def test_open_window_after_a_probe(spark):
    probes = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=2))], "id int, at timestamp_ntz")
    samples = spark.createDataFrame(
        [(T0, 99), (T0 + timedelta(seconds=10), 5), (T0 + timedelta(seconds=180), 77)], "ts timestamp_ntz, v int"
    )
    got = window_peak_after(probes, samples, "id", "at", "ts", "v", 180)
    assert {r["id"]: r["max_value"] for r in got.collect()} == {1: 5, 2: 0}
    kept = window_peak_after(probes, samples, "id", "at", "ts", "v", 180, empty_as_zero=False)
    assert [r["id"] for r in kept.collect()] == [1]


@pytest.mark.parametrize("split", [False, True])
def test_asof_takes_the_peak_and_includes_the_instant(spark, split):
    points = spark.createDataFrame([(1, 10), (3, 4), (5, 11)], "t int, v int")
    probes = spark.createDataFrame([(0, "x"), (1, "a"), (4, "b"), (5, "c")], "at int, name string")
    got = asof_peak(points, probes, "t", "at", {"top": F.col("v")}, split=split)
    assert {r["name"]: r["top"] for r in got.collect()} == {"x": None, "a": 10, "b": 10, "c": 11}


@pytest.mark.parametrize("split", [False, True])
def test_state_label_closed_bounds_and_backup_first(spark, split):
    spans = spark.createDataFrame([(10, 20, "backup"), (20, 30, "restore"), (50, 50, "restore")], "s int, e int, kind string")
    samples = spark.createDataFrame([(t,) for t in (9, 10, 20, 21, 30, 31, 50)], "t int")
    got = state_label(samples, spans, "t", "s", "e", "kind", split=split)
    assert {r["t"]: r["state"] for r in got.collect()} == {
        9: "idle", 10: "backup", 20: "backup", 21: "restore", 30: "restore", 31: "idle", 50: "restore",
    }


@pytest.mark.parametrize("split", [False, True])
def test_latest_cycle_before_target_breaks_ties_by_first_id(spark, split):
    cycles = spark.createDataFrame([("v1", 1, "c1"), ("v1", 5, "c3"), ("v1", 5, "c2"), ("v2", 2, "d1")], "chain string, ts int, id string")
    targets = spark.createDataFrame([("v1", 0), ("v1", 5), ("v1", 4), ("v2", 9)], "chain string, at int")
    got = latest_before(cycles, targets, "ts", "id", "at", ["chain"], split=split)
    assert {(r["chain"], r["at"]): r["target_cycle"] for r in got.collect()} == {
        ("v1", 0): None, ("v1", 5): "c2", ("v1", 4): "c1", ("v2", 9): "d1",
    }


@pytest.mark.parametrize("split", [False, True])
def test_plans_by_position(spark, split):
    cycles = spark.createDataFrame([("v1", c) for c in ("c3", "c1", "c2")] + [("v2", "d1")], "chain string, id string")
    requests = spark.createDataFrame([(1, "v1", 2), (2, "v1", 9), (3, "v2", 1), (4, "v3", 1)], "request int, chain string, n bigint")
    picked = oldest_n(cycles, requests, "chain", "id", "n", split=split).collect()
    assert sorted((r["request"], r["id"], r["replay_order"], r["available"], r["selected"]) for r in picked) == [
        (1, "c1", 1, 3, 2), (1, "c2", 2, 3, 2), (2, "c1", 1, 3, 3), (2, "c2", 2, 3, 3), (2, "c3", 3, 3, 3), (3, "d1", 1, 1, 1),
    ]
    targets = spark.createDataFrame([("v1", "c2"), ("v1", "c25"), ("v1", "b"), ("v2", "z")], "chain string, upto string")
    prefix = replay_prefix(cycles, targets, "chain", "id", "upto", split=split).collect()
    assert sorted((r["upto"], r["id"]) for r in prefix) == [
        ("c2", "c1"), ("c2", "c2"), ("c25", "c1"), ("c25", "c2"), ("z", "d1"),
    ]


@pytest.mark.parametrize("split", [False, True])
def test_prefix_and_counter_rules(spark, split):
    judged = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, True)], "r string, k int, ok boolean")
    got = prefix_ok(judged, ["r"], ["k"], "ok", split=split).collect()
    assert {r["k"]: r["prefix_ok"] for r in got} == {1: True, 2: False, 3: False}
    polls = spark.createDataFrame([("h", 1, 0, 0), ("h", 2, 25, 100), ("h", 3, 25, 100)], "h string, k int, idle int, total int")
    rates = counter_rate(polls, ["h"], ["k"], "idle", "total", split=split).collect()
    assert {r["k"]: r["busy_percent"] for r in rates} == {1: None, 2: 75.0, 3: 0.0}


def test_grids_in_blocks_are_whole(spark, monkeypatch):
    from cycle_analytics.operators import grid

    monkeypatch.setattr(grid, "SLOTS_A_BLOCK", 7)
    bounds = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2026-01-01 00:00:05', timestamp_ntz'2026-01-01 00:10:00'), ('b', timestamp_ntz'2026-01-01', timestamp_ntz'2026-01-01'), ('c', timestamp_ntz'2026-01-02', timestamp_ntz'2026-01-01') AS t(k, lo, hi)")
    got = sorted((r.k, r.slot.isoformat()) for r in grid.regular_grid(bounds, "lo", "hi", 42, ["k"]).collect())
    want = bounds.where("lo <= hi").selectExpr("k", "explode(sequence(lo, hi, interval 42 seconds)) AS slot").collect()
    assert got == sorted((r.k, r.slot.isoformat()) for r in want) and len(got) == 16


def test_wide_rows_make_a_group_hot_earlier(spark, monkeypatch):
    rows = spark.range(4000).select(
        (F.col("id") % 3).alias("k"), "id", *[(F.col("id") * j).cast("double").alias(f"v{j}") for j in range(40)]
    )
    assert ordered.hot_limit(rows) < ordered.hot_limit(rows.select("k", "id")) <= ordered.HOT_ROWS
    monkeypatch.setattr(ordered, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(ordered, "is_small", lambda df: False)
    blocked = []
    in_blocks = ordered._in_blocks
    monkeypatch.setattr(ordered, "_in_blocks", lambda *a: blocked.append(1) or in_blocks(*a))
    found = ordered.running(rows, ["k"], ["id"], {"n": ordered.number()}).select("id", "n").collect()
    assert blocked and {(r["id"], r["n"]) for r in found} == {(i, i // 3 + 1) for i in range(4000)}


def test_whole_groups_are_dealt_by_what_is_read(spark, tmp_path, monkeypatch):
    spark.range(20_000).select((F.col("id") % 997).alias("k"), "id").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(ordered, "GROUP_BYTES", ordered.tasks_for(df, 1) // 16, raising=False)
    found = running(df, ["k"], ["id"], {"n": number()}, split=True)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 16
    assert found.where((F.col("n") - 1) * 997 + F.col("k") != F.col("id")).isEmpty() and found.count() == 20_000


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_large_requests_are_computed_once_and_meet_reached_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(sequence, "is_small", lambda df, limit=0: bool(limit), raising=False)
    monkeypatch.setattr(sequence, "FEW_BYTES", few, raising=False)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def asked(request):
        seen.add(1)
        return "a" if request % 3 else "c"

    asked = asked.asNondeterministic()
    cycles = spark.createDataFrame([(c, f"{i:04d}") for c in "ab" for i in range(50)], "chain string, id string")
    requests = spark.range(40).select(
        F.col("id").alias("request"), asked("id").alias("chain"), (F.col("id") % 5 * 20).alias("n")
    )
    got = oldest_n(cycles, requests, "chain", "id", "n", split=False).collect()
    want = {(r, i + 1, f"{i:04d}") for r in range(40) if r % 3 for i in range(min(50, r % 5 * 20))}
    assert {(r["request"], r["replay_order"], r["id"]) for r in got} == want and len(got) == len(want)
    assert seen.value <= 40
