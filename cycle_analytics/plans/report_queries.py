"""The reports as queries: telemetry made of the tables, written as the recorded files are, read back by their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics import schemas
from cycle_analytics.functions import clock
from cycle_analytics.plans import reports
from cycle_analytics.plans.registry import padded_id, query
from cycle_analytics.plans.table_queries import _rounded_test, _welch_sql
from cycle_analytics.session import new_folder
from cycle_analytics.sources import sinks, telemetry
from cycle_analytics.sources.tables import table

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
BEGIN = "2026-01-01 00:00:00"
STEP_SECONDS = 61


def _measures(schema: str) -> list[tuple[str, str, int]]:
    """(name, type, place) of the number columns of a telemetry schema."""
    return [
        (name, kind, j) for j, (name, kind) in enumerate(c.split(" ", 1) for c in schema.split(", ")) if kind in ("double", "bigint")
    ]


def _measure(kind: str, j: int, k, c):
    """Made-up numbers that floats hold exactly: eighths of seconds, and whole bytes."""
    value = (k * (7 + j) + c * (3 + 2 * j)) % (1000 + 37 * j)
    return value / F.lit(8.0) if kind == "double" else value * 1021


def _measure_sql(name: str, kind: str, j: int) -> str:
    value = f"((k * {7 + j} + c * {3 + 2 * j}) % {1000 + 37 * j})"
    return (f"{value} / 8.0::DOUBLE" if kind == "double" else f"{value} * 1021") + f" AS {name}"


def _numbers(schema: str, k, c) -> list:
    return [_measure(kind, j, k, c).alias(name) for name, kind, j in _measures(schema)]


def _numbers_sql(schema: str) -> str:
    return ", ".join(_measure_sql(*m) for m in _measures(schema))


def _stamp(k, begin: str = BEGIN, step: int = STEP_SECONDS):
    at = F.lit(begin).cast("timestamp_ntz") + clock.seconds(k * step)
    return F.concat(F.date_format(at, ISO), F.lit("+07:00"))


def _chain(c):
    return F.concat(F.lit("chain-v"), (c % 3 + 1).cast("string"))


def _recorded(df: DataFrame, purpose: str) -> str:
    path = new_folder(df.sparkSession, purpose)
    sinks.append_csv(df, path)
    return path


def _in_order(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[c.split(" ", 1)[0] for c in schema.split(", ")])


def backups(spark, root):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, root, "orders").select(
        _stamp(k).alias("timestamp"), padded_id("o_orderkey").alias("cycle_id"), _chain(c).alias("chain_version"), *_numbers(schemas.BACKUP, k, c)
    )
    return telemetry.backup_telemetry(spark, _recorded(_in_order(rows, schemas.BACKUP), "backup-telemetry"))


def restores(spark, root, begin=BEGIN, step=STEP_SECONDS):
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, root, "customer").select(
        _stamp(k, begin, step).alias("timestamp"), _chain(c).alias("target_chain_version"), (c % 9 + 1).alias("target_cycle_count"),
        *_numbers(schemas.RESTORE, k, c),
    )
    return telemetry.restore_telemetry(spark, _recorded(_in_order(rows, schemas.RESTORE), "restore-telemetry"))


def workflows(spark, root):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, root, "orders").select(
        _stamp(k).alias("timestamp"), F.when(k % 4 == 0, "restore").otherwise("backup").alias("workflow_type"), _chain(c).alias("chain_v"),
        padded_id("o_orderkey").alias("cycle_id"), *_numbers(schemas.WORKFLOW, k, c),
    )
    seconds = rows.withColumn("_k", F.col("cycle_id").cast("bigint")).withColumn(
        "total_workflow_sec", F.when(F.col("_k") % 10 != 0, F.col("total_workflow_sec"))
    )
    return telemetry.workflow_telemetry(spark, _recorded(_in_order(seconds, schemas.WORKFLOW), "workflow-telemetry"))


_AT = f"TIMESTAMP '{BEGIN}' + to_seconds(k * {STEP_SECONDS})"
_CHAIN_SQL = "'chain-v' || (c % 3 + 1)"
_CYCLE_SQL = "lpad(CAST(k AS VARCHAR), 12, '0')"
_BACKUPS = f"""b AS (SELECT {_AT} AS ended_at, {_CYCLE_SQL} AS cycle_id, {_CHAIN_SQL} AS chain_version, {_numbers_sql(schemas.BACKUP)}
    FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)), n AS (SELECT *, row_number() OVER (PARTITION BY chain_version ORDER BY ended_at, cycle_id) AS cycle_n FROM b)"""
_RESTORES = f"""r AS (SELECT k, {_AT} AS ended_at, {_CHAIN_SQL} AS target_chain_version, {_numbers_sql(schemas.RESTORE)}
    FROM (SELECT c_custkey AS k, c_nationkey AS c FROM customer))"""
_WORKFLOWS = f"""a AS (SELECT k, {_AT} AS ended_at, CASE WHEN k % 4 = 0 THEN 'restore' ELSE 'backup' END AS workflow_type, {_CHAIN_SQL} AS chain_v,
    {_CYCLE_SQL} AS cycle_id, {_numbers_sql(schemas.WORKFLOW)} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),
    f AS (SELECT * REPLACE (CASE WHEN k % 10 <> 0 THEN total_workflow_sec END AS total_workflow_sec), raw_size_bytes / 1048576.0::DOUBLE AS size FROM a)"""


@query(
    f"""WITH {_BACKUPS} SELECT chain_version, cycle_id, strftime(ended_at, '%H:%M') AS clock, {', '.join(reports.CYCLE_STAGES)},
          total_cycle_s - ({' + '.join(reports.CYCLE_STAGES)}) AS other_stages_s, total_cycle_s,
          coalesce(chain_version <> lag(chain_version) OVER (ORDER BY ended_at, cycle_id), false) AS chain_changed FROM b"""
)
def report_cycle_durations(spark, root):
    return reports.cycle_durations(backups(spark, root))


@query(
    f"""WITH {_BACKUPS} SELECT chain_version, cycle_id, cycle_n, replace(chain_version, 'chain-', '') || '-C' || cycle_n AS label,
          cycle_raw_total_size / 1048576.0::DOUBLE AS raw_mib, cycle_final_transfered_size / 1048576.0::DOUBLE AS transferred_mib FROM n"""
)
def report_cycle_volumes(spark, root):
    return reports.cycle_volumes(backups(spark, root))


@query(
    f"""WITH {_RESTORES} SELECT target_chain_version, {', '.join(reports.RESTORE_STAGES)}, total_restore_s - ({' + '.join(reports.RESTORE_STAGES)}) AS other_s,
          total_restore_s, ({' + '.join(reports.RESTORED_BYTES)}) / 1073741824.0::DOUBLE AS restored_gib FROM r"""
)
def report_restore_composition(spark, root):
    return reports.restore_composition(restores(spark, root))


@query(
    f"""WITH {_WORKFLOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY workflow_type, chain_v ORDER BY ended_at, cycle_id) AS cycle_n FROM f)
        SELECT workflow_type, chain_v, cycle_id, cycle_n, chain_v || '-C' || cycle_n AS label, raw_size_bytes AS package_bytes, size AS package_mib,
          CASE WHEN total_workflow_sec <> 0 THEN size / total_workflow_sec END AS throughput_mib_s FROM n"""
)
def report_workflow_throughput(spark, root):
    return reports.workflow_throughput(workflows(spark, root))


@query(
    f"""WITH {_WORKFLOWS}, e AS (SELECT CASE workflow_type WHEN 'backup' THEN 'view' ELSE 'purchase' END AS event_type,
          CASE WHEN total_workflow_sec <> 0 THEN size / total_workflow_sec END AS value FROM f), {_welch_sql('')}"""
)
def report_throughput_test(spark, root):
    return _rounded_test(reports.throughput_test(spark, workflows(spark, root)))


def _saved(stored: str, raw: str) -> str:
    return f"CASE WHEN ({raw}) = 0 AND ({stored}) = 0 THEN 0.0 WHEN ({raw}) = 0 THEN NULL ELSE (1 - ({stored}) / ({raw})) * 100 END"


_PG, _SENT = "pg_raw_size + pg_wal_raw_bytes", "pg_compressed_size + pg_wal_stored_bytes"
_ALL_RAW, _ALL_SENT = f"{_PG} + mongo_raw_size + unstr_raw_size", f"{_SENT} + mongo_compressed_size + unstr_compressed_size"
_ENGINES = {
    "pg": f"""pg_raw_size AS pg_base_raw, pg_compressed_size AS pg_base_stored, {_saved('pg_compressed_size', 'pg_raw_size')} AS pg_base_eff_pct,
        pg_wal_raw_bytes AS pg_wal_raw, pg_wal_stored_bytes AS pg_wal_stored, {_saved('pg_wal_stored_bytes', 'pg_wal_raw_bytes')} AS pg_wal_eff_pct,
        {_PG} AS pg_total_raw, {_SENT} AS pg_total_stored, {_saved(_SENT, _PG)} AS pg_total_eff_pct,
        pg_basebackup_s + pg_wal_extract_s + pg_wal_compress_s AS pg_time_s, wal_file_count AS wal_files""",
    "mongo": f"""mongo_basebackup_raw_bytes AS mongo_base_raw, mongo_oplog_raw_bytes AS mongo_oplog_raw, mongo_oplog_stored_bytes AS mongo_oplog_stored,
        {_saved('mongo_oplog_stored_bytes', 'mongo_oplog_raw_bytes')} AS mongo_oplog_eff_pct, mongo_raw_size AS mongo_total_raw,
        mongo_compressed_size AS mongo_total_stored, {_saved('mongo_compressed_size', 'mongo_raw_size')} AS mongo_total_eff_pct,
        mongo_basebackup_s + mongo_oplog_extract_s + mongo_oplog_compress_s AS mongo_time_s""",
    "unstr": f"""unstr_base_size AS unstr_base_raw, unstructured_raw_bytes AS unstr_delta_raw, unstructured_stored_bytes AS unstr_delta_stored,
        {_saved('unstructured_stored_bytes', 'unstructured_raw_bytes')} AS unstr_delta_eff_pct, unstr_raw_size AS unstr_total_raw,
        unstr_compressed_size AS unstr_total_stored, {_saved('unstr_compressed_size', 'unstr_raw_size')} AS unstr_total_eff_pct,
        unstructured_chunk_s + unstr_base_s + unstructured_delta_compress_s AS unstr_time_s, pfc_chunk_count AS chunks""",
}
_NAMED = f"WITH {_BACKUPS} SELECT chain_version, 'cycle-' || cycle_n AS cycle_name"


@query(
    f"""{_NAMED}, {', '.join(_ENGINES.values())}, {_ALL_RAW} AS total_raw, {_ALL_SENT} AS total_sent, {_saved(_ALL_SENT, _ALL_RAW)} AS total_eff_pct,
          transfer_s AS net_time_s, total_cycle_s AS total_time_s FROM n"""
)
def report_engine_matrix(spark, root):
    return reports.engine_matrix(backups(spark, root))


@query(f"{_NAMED}, {_ENGINES['unstr']} FROM n")
def report_unstructured_matrix(spark, root):
    return reports.engine_matrix(backups(spark, root), "unstr")


@query(f"{_NAMED}, {_ENGINES['mongo']} FROM n")
def report_mongo_matrix(spark, root):
    return reports.engine_matrix(backups(spark, root), "mongo")


@query(f"{_NAMED}, {_ENGINES['pg']} FROM n")
def report_postgres_matrix(spark, root):
    return reports.engine_matrix(backups(spark, root), "pg")


_CHECKS = {
    "unstr_total_raw": ("unstr_raw_size", "unstr_base_size + unstructured_raw_bytes"),
    "mongo_total_raw": ("mongo_raw_size", "mongo_basebackup_raw_bytes + mongo_oplog_raw_bytes"),
    "transferred": ("cycle_final_transfered_size", "cycle_total_stored_bytes"),
    "stored_parts": ("cycle_total_stored_bytes", _ALL_SENT),
}


@query(
    f"WITH {_BACKUPS} " + " UNION ALL ".join(
        f"SELECT chain_version, cycle_id, '{name}' AS \"check\", {a}::DOUBLE AS recorded, ({b})::DOUBLE AS computed FROM b WHERE {a} <> {b}"
        for name, (a, b) in _CHECKS.items()
    )
)
def report_engine_offenders(spark, root):
    return reports.engine_offenders(backups(spark, root))


def snapshots(spark, root):
    """Totals of a store at every event."""
    rows = table(spark, root, "events").select(
        F.concat(F.date_format("ts", ISO), F.lit("+07:00")).alias("timestamp"), (F.col("event_id") * 3 + F.col("user_id")).alias("orders_total"),
        F.col("event_id").alias("customers_total"), F.col("user_id").alias("products_total"),
    )
    return telemetry.snapshots(spark, _recorded(rows, "snapshots"), schemas.PG_SNAPSHOT)


_UNTIL = "2024-01-20 12:00:00"


def _until():
    return F.lit(_UNTIL).cast("timestamp_ntz")


@query(f"SELECT ts, event_id * 3 + user_id AS orders_total FROM events WHERE ts <= TIMESTAMP '{_UNTIL}'")
def report_growth(spark, root):
    return reports.growth(snapshots(spark, root), "orders_total", restores(spark, root), _until())[0]


@query(
    f"""WITH r AS (SELECT 'chain-v' || (c_nationkey % 3 + 1) AS target_chain_version, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey * 977) AS ended_at FROM customer)
        SELECT target_chain_version, ended_at, max(event_id * 3 + user_id) AS restored_level
        FROM r JOIN events e ON e.ts > ended_at AND e.ts < ended_at + INTERVAL 180 SECOND GROUP BY ALL"""
)
def report_restored_levels(spark, root):
    return reports.growth(snapshots(spark, root), "orders_total", restores(spark, root, "2024-01-01 00:00:00", 977))[1]


@query(
    f"""SELECT ts, event_id * 3 + user_id AS orders_total, event_id AS customers_total, user_id AS products_total,
          CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN 'left' ELSE 'right' END AS panel FROM events WHERE ts <= TIMESTAMP '{_UNTIL}'"""
)
def report_split_panels(spark, root):
    return reports.split_panels(snapshots(spark, root), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), _until())


def operations(spark, root):
    rows = table(spark, root, "events").select(
        F.concat(F.date_format("ts", ISO), F.lit("+07:00")).alias("timestamp"), F.upper("event_type").alias("action")
    )
    return telemetry.operation_log(spark, _recorded(rows, "operations"))


@query(
    f"""WITH c AS (SELECT upper(event_type) AS action, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{_UNTIL}' GROUP BY 1)
        SELECT action, n, CAST(sum(n) OVER () AS BIGINT) AS total, n / sum(n) OVER () * 100 AS pct FROM c"""
)
def report_operation_distribution(spark, root):
    return reports.operation_distribution(operations(spark, root), _until())


_ACTIONS = ["CLICK", "ERROR", "VIEW"]


@query(
    f"""WITH c AS (SELECT upper(event_type) AS action, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{_UNTIL}' GROUP BY ALL),
        r AS (SELECT action, min(bucket) AS lo, max(bucket) AS hi FROM c GROUP BY 1),
        g AS (SELECT DISTINCT unnest(generate_series(lo, hi, INTERVAL 5 MINUTE)) AS bucket FROM r)
        SELECT g.bucket, {', '.join(f"CAST(coalesce(sum(n) FILTER (action = '{a}'), 0) AS BIGINT) AS {a}" for a in _ACTIONS)}
        FROM g LEFT JOIN c ON g.bucket = c.bucket GROUP BY g.bucket"""
)
def report_operation_rate(spark, root):
    return reports.operation_rate(operations(spark, root), _until(), _ACTIONS)


@query(
    f"""WITH {_WORKFLOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY chain_v ORDER BY ended_at, cycle_id) AS cycle_n, duration_cloud_transfer_sec AS took
          FROM f WHERE workflow_type = 'backup')
        SELECT replace(chain_v, 'chain-', '') || '-C' || cycle_n AS cycle, format('{{:,}}', raw_size_bytes) AS bytes, format('{{:,.2f}}', size) AS mib,
          format('{{:,.2f}}', took) AS seconds, CASE WHEN took <> 0 THEN format('{{:,.2f}}', size / took) END AS mib_s FROM n"""
)
def report_transfer_table(spark, root):
    return reports.transfer_table(workflows(spark, root))


def _day_charts(spark, root):
    """CPU and RAM charts of one day: times of day, some polls without any value."""
    clock_ = F.date_format("ts", "HH:mm:ss")
    k, u = F.col("event_id"), F.col("user_id")

    def chart(name: str, values: dict[str, object]) -> str:
        shown = [F.when(k % 9 == 0, "-").otherwise(v.cast("string")).alias(n) for n, v in values.items()]
        rows = table(spark, root, "events").select(clock_.alias("timestamp"), *shown, F.lit("-").alias("anomaly%"), F.lit("-").alias("annotations"))
        return _recorded(rows, name)

    cpu = chart("p-system_cpu-converted", {"user (%)": k % 50 / 2, "system (%)": u % 20 / 4, "softirq (%)": F.lit(0.25), "iowait (%)": F.lit(0.5)})
    ram = chart("p-system_ram-converted", {"free (GiBy)": u % 7 + 1, "used (GiBy)": k % 5 + 1, "cached (GiBy)": F.lit(2), "buffers (GiBy)": F.lit(0.5)})
    day = BEGIN.split()[0]
    return reports.primary_metrics(
        telemetry.converted_metric(spark, cpu, ["user", "system", "softirq", "iowait"], day),
        telemetry.converted_metric(spark, ram, ["free", "used", "cached", "buffers"], day),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith(("_max", "_avg"))})


@query(
    f"""WITH {_BACKUPS}, s AS (SELECT replace(chain_version, 'chain-', '') || '-C' || cycle_n AS name, total_cycle_s AS duration_s,
          ended_at - to_microseconds(CAST(total_cycle_s * 1000000 AS BIGINT)) - INTERVAL 35 SECOND AS lo, ended_at + INTERVAL 35 SECOND AS hi FROM n),
        m AS (SELECT TIMESTAMP '2026-01-01' + (date_trunc('second', ts) - date_trunc('day', ts)) AS ts, event_id % 50 / 2 + user_id % 20 / 4 + 0.25 + 0.5 AS cpu,
          (event_id % 5 + 1) / (event_id % 5 + 1 + user_id % 7 + 1 + 2 + 0.5::DOUBLE) * 100 AS ram FROM events WHERE event_id % 9 <> 0)
        SELECT name, duration_s, count(cpu) AS cpu_n, round(max(cpu), 6) AS cpu_max, round(avg(cpu), 6) AS cpu_avg,
          count(ram) AS ram_n, round(max(ram), 6) AS ram_max, round(avg(ram), 6) AS ram_avg
        FROM s LEFT JOIN m ON m.ts >= lo AND m.ts <= hi GROUP BY name, duration_s"""
)
def report_resource_stats(spark, root):
    found = reports.resource_stats(backups(spark, root), "total_cycle_s", "chain_version", "", _day_charts(spark, root), 35)
    return _rounded(found)


@query(
    f"""WITH {_WORKFLOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY chain_v ORDER BY ended_at, cycle_id) AS cycle_n FROM f WHERE total_workflow_sec IS NOT NULL),
        s AS (SELECT 'VM2 ' || replace(chain_v, 'chain-', '') || '-C' || cycle_n AS name, total_workflow_sec AS duration_s,
          ended_at - to_microseconds(CAST(total_workflow_sec * 1000000 AS BIGINT)) - INTERVAL 15 SECOND AS lo, ended_at + INTERVAL 15 SECOND AS hi FROM n),
        m AS (SELECT TIMESTAMP '2026-01-01' + (ts - date_trunc('day', ts)) AS ts, event_id % 64 / 4 AS cpu, user_id % 100 / 2 AS ram FROM events)
        SELECT name, duration_s, count(cpu) AS cpu_n, round(max(cpu), 6) AS cpu_max, round(avg(cpu), 6) AS cpu_avg,
          count(ram) AS ram_n, round(max(ram), 6) AS ram_max, round(avg(ram), 6) AS ram_avg
        FROM s LEFT JOIN m ON m.ts >= lo AND m.ts <= hi GROUP BY name, duration_s"""
)
def report_backup_host_stats(spark, root):
    lines = table(spark, root, "events").select(
        F.concat(F.lit("2026-01-01T"), F.date_format("ts", "HH:mm:ss.SSSSSS"), F.lit("+07:00")).alias("timestamp"),
        (F.col("event_id") % 64 / 4).alias("cpu_percent"), F.struct((F.col("user_id") % 100 / 2).alias("percent_used")).alias("memory"),
    )
    path = new_folder(spark, "monitor")
    sinks.append_json_lines(lines, path)
    metrics = reports.monitor_metrics(telemetry.monitor_samples(spark, path))
    known = workflows(spark, root).where("total_workflow_sec IS NOT NULL")
    return _rounded(reports.resource_stats(known, "total_workflow_sec", "chain_v", "VM2 ", metrics, 15))


@query(
    """WITH v AS (SELECT ts, event_id, event_type, value, ts - to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS lo FROM events),
       p AS (SELECT CASE event_type WHEN 'purchase' THEN 'backup' ELSE 'restore' END AS kind, lo, ts AS hi FROM v WHERE event_type IN ('purchase', 'signup') AND event_id % 50 > 24),
       w AS (SELECT min(lo) - INTERVAL 2 MINUTE AS lo, max(hi) + INTERVAL 2 MINUTE AS hi FROM p WHERE kind = 'backup'),
       m AS (SELECT v.ts AS slot, v.value, CASE WHEN bool_or(p.kind = 'backup') THEN 'backup' WHEN bool_or(p.kind = 'restore') THEN 'restore' ELSE 'idle' END AS state
             FROM v JOIN w ON v.ts BETWEEN w.lo AND w.hi LEFT JOIN p ON v.ts BETWEEN p.lo AND p.hi WHERE v.event_type = 'view' GROUP BY v.ts, v.value),
       b AS (SELECT min(slot) AS lo, max(slot) AS hi FROM m)
       SELECT slot, value, state, coalesce((value + lag(value) OVER (ORDER BY slot)) / 2, value) AS smoothed, false AS is_imputed FROM m
       UNION ALL SELECT lo - to_seconds(42 * k), NULL, 'idle', NULL, true FROM b, range(1, 4) AS places(k)
       UNION ALL SELECT hi + to_seconds(42 * k), NULL, 'idle', NULL, true FROM b, range(1, 3) AS places(k)"""
)
def report_usage_timeline(spark, root):
    events = table(spark, root, "events")
    spans = events.where("event_type IN ('purchase', 'signup') AND event_id % 50 > 24").select(
        F.when(F.col("event_type") == "purchase", "backup").otherwise("restore").alias("kind"),
        clock.span_start(F.col("ts"), F.col("value")).alias("start"), F.col("ts").alias("end"),
    )
    samples = events.where("event_type = 'view'").select("ts", "value")
    found = reports.usage_timeline(samples, spans, "ts", "value", "backup", before=3, after=2)
    return found.select("slot", "value", "state", "smoothed", "is_imputed")


@query(
    f"""WITH {_BACKUPS} SELECT chain_version AS chain, cycle_id AS cycle, CAST(sum(cycle_raw_total_size) OVER (PARTITION BY chain_version ORDER BY cycle_id) AS BIGINT) / 1073741824.0::DOUBLE AS cumulative_gib,
          total_cycle_s AS time, transfer_s AS rate, total_cycle_s > 20 AS is_slow FROM b"""
)
def report_scalability(spark, root):
    cycles = backups(spark, root).select(
        F.col("chain_version").alias("chain"), F.col("cycle_id").alias("cycle"), F.col("cycle_raw_total_size").alias("raw_size"),
        F.col("total_cycle_s").alias("time"), F.col("transfer_s").alias("rate"),
    )
    return reports.scalability(cycles)
