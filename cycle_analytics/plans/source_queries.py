"""Queries that go through files and streams: written to the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cycle_analytics.functions import clock, crypto, derive
from cycle_analytics.operators import chunks
from cycle_analytics.plans.integrity_queries import (
    _CHUNKS, CHUNK_BYTES, DUMMY_KEY, REQUEST_SQL, document_files, request_bodies,
)
from cycle_analytics.plans.registry import cents, padded_id, query
from cycle_analytics.session import new_folder
from cycle_analytics.sources import packages, sinks, telemetry
from cycle_analytics.sources.tables import table, table_stream
from cycle_analytics.streaming import listener, passes, samples
from cycle_analytics.streaming.store import Store

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@query(
    """WITH v AS (SELECT event_type, ts, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS c FROM events)
       SELECT event_type, count(*) AS n_rows, count(c) AS n_dropped_policy, CAST(sum(c) AS BIGINT) AS sum_cents,
         round(avg(c) / 100, 6) AS mean_drop, round(sum(coalesce(c, 0)) / count(*) / 100, 6) AS mean_zero,
         min(ts) AS first_at, max(ts) AS last_at FROM v GROUP BY event_type"""
)
def source_csv_roundtrip(spark, root):
    events = table(spark, root, "events")
    shown = F.when(F.col("event_id") % 10 == 0, telemetry.MISSING).otherwise(F.col("value").cast("string"))
    padded = events.select(
        F.concat(F.date_format("ts", ISO), F.lit("+07:00")).alias(" timestamp "),
        F.col("event_type").alias(" action"), F.concat(F.lit("  "), shown).alias("value "),
    )
    path = new_folder(spark, "events-csv")
    sinks.append_csv(padded, path)
    back = telemetry.read_csv(spark, path, "timestamp string, action string, value string")
    numbers = back.select(
        F.col("action").alias("event_type"), clock.wall_clock(F.col("timestamp")).alias("ts"),
        derive.number_or(F.col("value"), "drop").alias("kept"), derive.number_or(F.col("value"), "zero").alias("filled"),
    )
    return numbers.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("kept").alias("n_dropped_policy"), F.sum(cents("kept")).alias("sum_cents"),
        F.round(F.avg(cents("kept")) / 100, 6).alias("mean_drop"), F.round(F.avg(cents("filled")) / 100, 6).alias("mean_zero"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


@query(
    """SELECT event_type AS event, count(*) AS n, round(avg(value), 6) AS cpu_mean, CAST(sum(event_id % 100) AS DOUBLE) AS mem_sum,
         max(value) AS cpu_max, CAST(sum(user_id) AS DOUBLE) AS load_sum FROM events GROUP BY 1"""
)
def jsonl_roundtrip(spark, root):
    events = table(spark, root, "events")
    used = F.col("event_id") % 100
    lines = events.select(
        F.concat(F.date_format("ts", ISO), F.lit("+07:00")).alias("timestamp"), F.col("value").alias("cpu_percent"),
        F.struct(
            F.lit(100).cast("bigint").alias("total_bytes"), (100 - used).alias("available_bytes"),
            derive.gauge_percent(used, F.lit(100)).alias("percent_used"),
        ).alias("memory"),
        F.array(F.col("user_id").cast("string"), F.lit("0.00")).alias("load_average"), F.col("event_type").alias("event"),
    )
    path = new_folder(spark, "events-jsonl")
    sinks.append_json_lines(lines, path)
    back = telemetry.monitor_samples(spark, path)
    load = F.aggregate(F.transform("load_average", lambda x: x.try_cast("double")), F.lit(0.0), lambda a, b: a + b)
    return back.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("cpu_percent"), 6).alias("cpu_mean"),
        F.sum("memory.percent_used").alias("mem_sum"), F.max("cpu_percent").alias("cpu_max"), F.sum(load).alias("load_sum"),
    )


@query(
    """SELECT event_id, ts AS from_iso, ts AS from_naive, ts - INTERVAL 7 HOUR AS as_instant, date_trunc('second', ts)::TIMESTAMP AS from_clock,
         date_trunc('milliseconds', ts)::TIMESTAMP + INTERVAL 7 HOUR AS from_millis FROM events"""
)
def clock_normalise(spark, root):
    ts = F.col("ts")
    texts = table(spark, root, "events").select(
        "event_id", F.concat(F.date_format(ts, ISO), F.lit("+07:00")).alias("iso"), F.date_format(ts, ISO).alias("naive"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"), clock.time_of_day(ts).alias("hms"),
        F.unix_millis(ts.cast("timestamp")).alias("millis"),
    )
    return texts.select(
        "event_id", clock.wall_clock(F.col("iso")).alias("from_iso"), clock.wall_clock(F.col("naive")).alias("from_naive"),
        clock.instant(F.col("naive")).cast("timestamp_ntz").alias("as_instant"),
        clock.on_date(F.col("day"), F.col("hms")).alias("from_clock"), clock.local_from_millis(F.col("millis")).alias("from_millis"),
    )


@query(
    "SELECT 'chain-' || lang AS chain_v, source AS cycle_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY ALL"
)
def cycle_inventory(spark, root):
    path = new_folder(spark, "packages")
    lines = document_files(spark, root).select("chain_v", "cycle_id", F.col("content").cast("string").alias("value"))
    lines.hint("rebalance", "chain_v", "cycle_id").write.partitionBy("chain_v", "cycle_id").text(path)
    return packages.cycles(spark, path).drop("n_files")


@query(
    """SELECT 'chain-v' || (o_custkey % 3 + 1) AS chain_v, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id,
         o_orderdate - INTERVAL 7 HOUR AS cycle_at FROM orders WHERE o_orderkey % 5 NOT IN (0, 1, 2)"""
)
def catalog_listing(spark, root):
    orders = table(spark, root, "orders")
    kind = F.col("o_orderkey") % 5
    document = F.to_json(
        F.struct(
            F.lit(crypto.ALGORITHM).alias("alg"), F.concat(F.lit("chain-v"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("chain_v"),
            F.when(kind == 0, "").otherwise(padded_id("o_orderkey")).alias("cycle_id"),
            F.when(kind != 1, F.date_format("o_orderdate", ISO)).alias("cycle_timestamp"),
        )
    )
    path = new_folder(spark, "catalog")
    orders.select(F.when(kind == 2, "{broken").otherwise(document).alias("value")).write.text(path)
    catalog = packages.catalog_documents(spark, path, pattern="*", multi_line=False)
    from cycle_analytics.operators.ledger import valid_catalog

    kept = valid_catalog(catalog, with_stamp=True)
    return kept.select("chain_v", "cycle_id", clock.instant(F.col("cycle_timestamp")).cast("timestamp_ntz").alias("cycle_at"))


@query(
    f"""SELECT 'chain-' || lang AS chain_v, source AS cycle_id,
          CAST(sum(CASE WHEN lang = 'fr' THEN 1 ELSE {_CHUNKS} END) AS BIGINT) AS n_chunks,
          CAST(sum(CASE WHEN lang = 'fr' THEN least(strlen(text), {CHUNK_BYTES}) ELSE strlen(text) END) AS BIGINT) AS bytes
        FROM documents GROUP BY lang, source"""
)
def restore_staging(spark, root):
    """Stage everything, then stage one chain again with only its first chunks."""
    path, keys = new_folder(spark, "staging"), ["chain_v", "cycle_id"]
    rows = chunks.chunked(document_files(spark, root), "content", CHUNK_BYTES).drop("doc_id")
    sinks.replace_partitions(rows, path, keys)
    sinks.replace_partitions(rows.where("chain_v = 'chain-fr' and chunk_no = 0"), path, keys)
    back = spark.read.schema("rel_path string, chunk_no int, chunk binary, chain_v string, cycle_id string").parquet(path)
    return back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("bytes"))


@query(
    f"""SELECT 'chain-' || lang AS chain_v, source AS cycle_id, CAST(sum({_CHUNKS}) + 2 AS BIGINT) AS n_chunks,
          CAST(sum(strlen(text)) + 8 AS BIGINT) AS package_bytes, 2 AS uploads, true AS done
        FROM documents GROUP BY lang, source HAVING count(*) FILTER (doc_id % 97 = 0) = 0"""
)
def stream_backup_pass(spark, root):
    """Documents arrive as packages; one altered file keeps its whole package back."""
    store_root = new_folder(spark, "backup-store")
    store = passes.new_store(spark, store_root)
    ring = crypto.key_ring(spark, key=DUMMY_KEY)
    targets = {name: f"{store_root}/target-{name}" for name in ("general", "immutable")}

    def each(batch, batch_id):
        files = batch.select(
            F.concat(F.lit("chain-"), "lang").alias("chain_v"), F.col("source").alias("cycle_id"),
            F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("text").cast("binary").alias("content"), "doc_id",
        )
        digest = F.when(F.col("doc_id") % 97 == 0, F.lit("0" * 64)).otherwise(F.sha2("content", 256))
        lines = files.select("chain_v", "cycle_id", F.concat(digest, F.lit("  "), "rel_path").alias("value"))
        required = files.select("chain_v", "cycle_id").distinct().select(
            "*", F.explode(F.array(F.lit("manifest.json"), F.lit("checksums.sha256"))).alias("rel_path")
        ).withColumn("content", F.when(F.col("rel_path") == "manifest.json", "{}").otherwise("listed").cast("binary"))
        passes.run_pass(
            store, files.drop("doc_id").unionByName(required), batch_id, ring, targets, lines=lines, chunk_bytes=CHUNK_BYTES
        )

    stream = table_stream(spark, root, "documents")
    passes.start(stream, each, f"{store_root}/checkpoint", once=True).start().awaitTermination()
    stages = store.read("ledger").groupBy("chain_v", "cycle_id").agg(
        F.count_if(F.col("stage") == "uploaded").cast("int").alias("uploads"), F.bool_or(F.col("stage") == "done").alias("done")
    )
    catalog = store.read("catalog").select("chain_v", "cycle_id", "n_chunks", "package_bytes")
    return catalog.join(stages, ["chain_v", "cycle_id"])


@query(
    """SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS bucket, event_type, count(*) AS n, max(value) AS max_value, round(sum(value), 4) AS sum_value
       FROM events GROUP BY ALL"""
)
def stream_sample_windows(spark, root):
    schema = {"windows": "bucket timestamp_ntz, event_type string, n bigint, max_value double, sum_value double"}
    store = Store(spark, new_folder(spark, "windows"), schema).create()
    stats = samples.window_stats(table_stream(spark, root, "events"), "ts", ["event_type"], "value", 60)
    samples.collect_updates(stats, store, "windows").awaitTermination()
    return samples.current_windows(store, "windows", ["event_type"]).withColumn("sum_value", F.round("sum_value", 4))


@query(
    f"""WITH q AS ({REQUEST_SQL}) SELECT CAST(request_id AS VARCHAR) AS request_id, error_reason, version, chain_n, source, send, dest_root FROM q"""
)
def stream_request_listener(spark, root):
    folder = new_folder(spark, "requests")
    request_bodies(spark, root).select(F.col("request_id").cast("string").alias("request_id"), "body").write.parquet(folder)
    store = listener.new_store(spark, new_folder(spark, "listener"))
    stream = spark.readStream.schema("request_id string, body string").parquet(folder)
    listener.listen(stream, store, "/incoming", once=True).awaitTermination()
    return store.read("requests").drop("batch").withColumn("chain_n", F.col("chain_n").cast("double"))
