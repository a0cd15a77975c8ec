"""Edge rules of the column functions."""

import base64
import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cycle_analytics.functions import clock, crypto, derive, documents, text
from cycle_analytics.functions.student_t import log_gamma, two_sided_p
from cycle_analytics.operators import reshape


def one(spark, column, **values):
    names = list(values) or ["_"]
    row = tuple(values.values()) or (0,)
    return spark.createDataFrame([row], ", ".join(f"{n} {_type(v)}" for n, v in zip(names, row))).select(column.alias("x")).first()["x"]


def _type(value):
    return {bool: "boolean", int: "bigint", float: "double", bytes: "binary"}.get(type(value), "string")


def test_offsets_are_stripped_and_naive_stamps_get_the_default_zone(spark):
    assert one(spark, clock.wall_clock(F.col("t")), t=" 2026-06-20T01:59:27+07:00") == datetime(2026, 6, 20, 1, 59, 27)
    assert one(spark, clock.wall_clock(F.col("t")), t="2026-06-20T02:12:09.787145+07:00") == datetime(2026, 6, 20, 2, 12, 9, 787145)
    naive = clock.instant(F.col("t")).cast("timestamp_ntz")
    assert one(spark, naive, t="2026-06-20T01:00:00") == datetime(2026, 6, 19, 18)
    assert one(spark, naive, t="2026-06-20T01:00:00+02:00") == datetime(2026, 6, 19, 23)
    assert one(spark, naive, t="not a stamp") is None
    assert one(spark, clock.local_from_millis(F.col("t")), t=1781900067000) == datetime(2026, 6, 20, 3, 14, 27)


def test_spans_keep_the_date_across_midnight(spark):
    end = clock.wall_clock(F.col("t"))
    assert one(spark, clock.span_start(end, F.lit(70.02)), t="2026-06-20T00:00:30+07:00") == datetime(2026, 6, 19, 23, 59, 19, 980000)
    assert one(spark, clock.on_date("2026-06-20", F.col("t")), t=" 03:14:27 ") == datetime(2026, 6, 20, 3, 14, 27)


@pytest.mark.parametrize(
    "stored,raw,expected,undefined",
    [(0, 0, 0.0, False), (5, 0, None, True), (25, 100, 75.0, False), (None, 100, 0.0, False), (120, 100, -20.0, False)],
)
def test_efficiency(spark, stored, raw, expected, undefined):
    df = spark.createDataFrame([(stored, raw)], "s bigint, r bigint")
    row = df.select(derive.efficiency(F.col("s"), F.col("r")).alias("e"), derive.ratio_undefined(F.col("s"), F.col("r")).alias("u")).first()
    assert row["e"] == (pytest.approx(expected) if expected is not None else None)
    assert row["u"] is undefined


def test_numbers_sums_and_gauges(spark):
    assert one(spark, derive.number_or(F.col("t"), "drop"), t="-") is None
    assert one(spark, derive.number_or(F.col("t"), "zero"), t="-") == 0.0
    df = spark.createDataFrame([(10.0, 3.0, None)], "a double, b double, c double")
    assert df.select(derive.residual(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 7.0
    assert df.select(derive.used_percent(F.col("b"), F.lit(-3.0))).first()[0] is None
    assert df.select(derive.gauge_percent(F.col("b"), F.lit(0))).first()[0] == 0.0
    assert df.select(derive.busy_percent(F.lit(25), F.lit(100))).first()[0] == 75.0
    assert df.select(derive.busy_percent(F.lit(25), F.lit(0))).first()[0] == 0.0
    assert df.select(derive.clip(F.col("a"), 0, 4)).first()[0] == 4.0
    assert df.select(derive.restore_status(F.lit(0))).first()[0] == "✅ Valid"
    assert df.select(derive.restore_status(F.lit(-4))).first()[0] == "Delta (-4)"
    assert df.select(derive.restore_status(F.lit(None).cast("int"))).first()[0] == "Delta (nan)"
    assert df.select(derive.encryption_overhead_ok(F.lit(798156828), F.lit(798156800))).first()[0]


def test_display_forms(spark):
    assert one(spark, text.thousands(F.col("x")), x=798156800) == "798,156,800"
    assert one(spark, text.thousands(F.col("x"), 2), x=1234.005) == f"{1234.005:,.2f}"
    assert one(spark, text.percent(F.col("x")), x=48.4251) == "48.43%"
    assert one(spark, derive.cycle_label(F.col("c"), F.lit(3)), c="chain-v2") == "v2-C3"
    filled = text.fill_placeholders("s3a://b/{chain_v}/{cycle_id}/{src}", F.lit("f"), F.lit("c1"), F.lit("v1"))
    assert one(spark, filled) == "s3a://b/v1/c1/f"
    assert one(spark, text.cycle_from_name(F.col("n")), n="20260620_015817.tar.aes256gcm.meta.json") == "20260620_015817"


@pytest.mark.parametrize(
    "path,bad",
    [("/x", True), ("\\x", True), ("a/../b", True), ("..", True), ("a/..b", False), ("a/b.txt", False), ("./a", False)],
)
def test_unsafe_paths(spark, path, bad):
    assert one(spark, text.unsafe_path(F.col("p")), p=path) is bad


def test_p_values_as_columns(spark):
    cases = [  # t, degrees of freedom, two-sided p
        (-3.9771, 20.011, 7.4164e-4), (0.0, 5.0, 1.0), (2.2281388519649385, 10.0, 0.05), (12.706204736174694, 1.0, 0.05),
        (1.0, 1.0, 0.5), (-1.0, 2.0, 1 - 1 / 3**0.5), (1.959963984540054, 1e9, 0.05), (40.0, 30.0, 1.61e-27),
        (0.001, 3.7, 0.99925), (3.2905267314919255, 1e6, 0.001),
    ]
    rows = spark.createDataFrame([(k, t, df) for k, (t, df, _) in enumerate(cases)] + [(99, None, 3.0)], "k int, t double, df double")
    found = {r.k: r.p for r in rows.select("k", two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()}
    assert found.pop(99) is None
    for k, (_, _, p) in enumerate(cases):
        assert found[k] == pytest.approx(p, rel=2e-2 if p < 1e-20 else 2e-4), cases[k]
    xs = [0.01, 0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)


REQUESTS = [
    ({"version": " chain-v1 ", "chain": 3}, None, ("chain-v1", 3, "local", True, "/in")),
    ({"chain_v": "chain-v2", "chain": "3", "source": "immutable"}, None, ("chain-v2", 3, "immutable", True, "/in")),
    ({"version": "", "chain_v": "b", "chain": 1}, None, ("b", 1, "local", True, "/in")),
    ({"version": "a", "chain": 2.9, "send_to_vm1": False}, None, ("a", 2, "local", False, "/in")),
    ({"version": "a", "chain": True, "send_to_vm1": 0}, None, ("a", 1, "local", False, "/in")),
    ({"version": "a", "chain": 1, "send_to_vm1": 0.5}, None, ("a", 1, "local", False, "/in")),
    ({"version": "a", "chain": 1, "send_to_vm1": "no"}, None, ("a", 1, "local", False, "/in")),
    ({"version": "a", "chain": 1, "send_to_vm1": ""}, None, ("a", 1, "local", False, "/in")),
    ({"version": "a", "chain": 1, "send_to_vm1": " OFF "}, None, ("a", 1, "local", False, "/in")),
    ({"version": "a", "chain": 1, "send_to_vm1": None}, None, ("a", 1, "local", True, "/in")),
    ({"version": "a", "chain": 1, "send_to_vm1": "maybe", "vm1_dest_root": " /x "}, None, ("a", 1, "local", True, "/x")),
    ({"version": "a", "chain": 1, "vm1_dest_root": 5}, None, ("a", 1, "local", True, "/in")),
    ({"version": "  ", "chain_v": "b", "chain": 1}, "missing_version", None),
    ({"version": 7, "chain": 1}, "missing_version", None),
    ({"chain": 1}, "missing_version", None),
    ({"version": "a"}, "missing_chain", None),
    ({"version": "a", "chain": None}, "missing_chain", None),
    ({"version": "a", "chain": "3.5"}, "chain_not_integer", None),
    ({"version": "a", "chain": [1]}, "chain_not_integer", None),
    ({"version": "a", "chain": 0}, "chain_below_one", None),
    ({"version": "a", "chain": "-2"}, "chain_below_one", None),
    ({"version": "a", "chain": 1, "source": "cloud"}, "invalid_source", None),
    ({"version": "a", "chain": 1, "source": None}, "invalid_source", None),
    ("{oops", "parse_error", None),
]


def test_request_rules(spark):
    bodies = [(i, body if isinstance(body, str) else json.dumps(body)) for i, (body, _, _) in enumerate(REQUESTS)]
    df = spark.createDataFrame(bodies, "id int, body string")
    rows = {r["id"]: r for r in documents.parsed_requests(df, "body", "/in").collect()}
    for i, (body, reason, values) in enumerate(REQUESTS):
        assert rows[i]["error_reason"] == reason, body
        if values:
            assert tuple(rows[i][c] for c in ("version", "chain_n", "source", "send", "dest_root")) == values, body
    cloud = [(1, json.dumps({"version": "a", "chain": 1, "source": "cloud"}))]
    row = documents.parsed_requests(spark.createDataFrame(cloud, "id int, body string"), "body", "/in", cloud_alias=True).first()
    assert (row["source"], row["error_reason"]) == ("general", None)


def test_manifest_summary_treats_an_empty_map_as_absent(spark):
    df = spark.createDataFrame(
        [({}, {"a": 3, "b": 4}), ({"x": 9}, {"a": 3}), (None, None)], "p map<string,bigint>, f map<string,bigint>"
    )
    summary = documents.manifest_summary({}, {"pfc": F.col("p").isNotNull(), "files": F.col("f").isNotNull()}, F.col("p"), F.col("f"))
    rows = df.select(summary.alias("s")).select("s.*").collect()
    assert [(r["components"], r["unstructured_raw_bytes"]) for r in rows] == [(["pfc", "files"], 7), (["pfc", "files"], 9), (None, None)]


KEY = bytes(range(100, 132))


def _sealed(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "c1", "f", 0, bytearray(b"hello")), ("v1", "c1", "f", 1, bytearray(b""))],
                                 "chain_v string, cycle_id string, rel_path string, chunk_no int, chunk binary")
    ring = crypto.key_ring(spark, key=KEY)
    identity = crypto.chunk_identity("chain_v", "cycle_id", "rel_path", "chunk_no")
    sealed = crypto.encrypted(rows, ring, "chunk", identity)
    path = str(tmp_path / "sealed")
    sealed.write.parquet(path)
    return sealed, spark.read.parquet(path), identity


def test_encryption_round_trip_and_layout(spark, tmp_path):
    sealed, stored, identity = _sealed(spark, tmp_path)
    opened = crypto.decrypted(stored, crypto.key_ring(spark, key=KEY), "artifact", identity)
    rows = {r["chunk_no"]: r for r in opened.withColumns({"n": crypto.nonce_hex(F.col("artifact")), "t": crypto.tag_hex(F.col("artifact"))}).collect()}
    assert bytes(rows[0]["content"]) == b"hello" and bytes(rows[1]["content"]) == b""
    assert all(len(r["artifact"]) - len(r["content"]) == 28 for r in rows.values())
    assert rows[0]["n"] == bytes(rows[0]["artifact"][:12]).hex() and rows[0]["t"] == bytes(rows[0]["artifact"][-16:]).hex()
    assert rows[0]["n"] != rows[1]["n"]
    wrong = crypto.decrypted(stored, crypto.key_ring(spark, key=bytes(32)), "artifact", identity)
    assert wrong.where("content is not null").count() == 0
    moved = crypto.decrypted(stored.withColumn("chunk_no", 1 - F.col("chunk_no")), crypto.key_ring(spark, key=KEY), "artifact", identity)
    assert moved.where("content is not null").count() == 0


def test_the_key_is_in_no_plan(spark, tmp_path, capsys):
    sealed, _, _ = _sealed(spark, tmp_path)
    sealed.explain("extended")
    plan = capsys.readouterr().out + str(sealed._jdf.queryExecution().toString())
    for shown in (KEY.hex(), KEY.hex().upper(), base64.b64encode(KEY).decode(), repr(KEY), str(list(KEY))[1:30]):
        assert shown not in plan


def test_key_text_rules(spark, monkeypatch):
    good = base64.b64encode(KEY).decode()
    assert crypto.decode_key(good) == KEY
    for bad in (None, "", "###", base64.b64encode(b"short").decode()):
        with pytest.raises(ValueError):
            crypto.decode_key(bad)
    assert one(spark, crypto.key_is_valid(F.col("k")), k=good) is True
    assert one(spark, crypto.key_is_valid(F.col("k")), k="###") is False
    monkeypatch.setenv(crypto.KEY_VARIABLE, good)
    assert bytes(crypto.key_ring(spark).first()["aes_key"]) == KEY


def test_values_are_not_dealt_by_their_unit(spark):
    rows = spark.range(5).select("id", (F.col("id") * 2048.0).alias("v"))
    found = reshape.shown(reshape.wide_to_long(rows, ["id"], {"v": "size"}, {"v": "mebibytes"}), reshape.unit_table(spark))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["shown_value"], r["shown_unit"]) for r in found.collect()) == [(k, 2.0 * k, "GiBy") for k in range(5)]
