"""Queries on time: spans and samples, as-of look-ups, order inside groups, buckets, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cycle_analytics.functions import clock, derive
from cycle_analytics.operators import asof, frequency, grid, intervals, sequence
from cycle_analytics.operators.ordered import running, total
from cycle_analytics.plans.registry import cents, padded_id, query
from cycle_analytics.plans.reports import restore_validation as validation_report
from cycle_analytics.sources.tables import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    """WITH spans AS (
         SELECT event_id, ts - to_microseconds(CAST(round(value * 1000000) AS BIGINT)) - INTERVAL 15 MINUTE AS lo,
                ts + INTERVAL 15 MINUTE AS hi
         FROM events WHERE event_type = 'purchase'),
       samples AS (SELECT ts, CAST(round(value * 100) AS BIGINT) AS value FROM events WHERE event_type <> 'purchase')
       SELECT s.event_id, count(m.value) AS n_samples, CAST(max(m.value) AS DOUBLE) AS max_value,
              round(avg(m.value), 6) AS avg_value
       FROM spans s LEFT JOIN samples m ON m.ts BETWEEN s.lo AND s.hi GROUP BY s.event_id"""
)
def span_metric_stats(spark, root):
    events = table(spark, root, "events")
    margin = clock.seconds(F.lit(900))
    spans = events.where("event_type = 'purchase'").select(
        "event_id", clock.span_start(F.col("ts"), F.col("value")).alias("start"), F.col("ts").alias("end")
    )
    samples = events.where("event_type <> 'purchase'").select("ts", cents("value").alias("value"))
    stats = intervals.span_stats(
        spans, samples, "event_id", F.col("start") - margin, F.col("end") + margin, "ts", "value",
        width_seconds=1800,
    )
    return stats.select(
        "event_id", "n_samples", F.col("max_value").cast("double").alias("max_value"), F.round("avg_value", 6).alias("avg_value")
    )


@query(
    """WITH spans AS (
         SELECT event_type, ts - to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS lo, ts AS hi
         FROM events WHERE event_type IN ('purchase', 'signup')),
       v AS (SELECT event_id, ts FROM events WHERE event_type = 'view'),
       m AS (SELECT v.event_id, bool_or(s.event_type = 'purchase') AS b, bool_or(s.event_type = 'signup') AS r
             FROM v JOIN spans s ON v.ts BETWEEN s.lo AND s.hi GROUP BY v.event_id)
       SELECT v.event_id, CASE WHEN m.b THEN 'backup' WHEN m.r THEN 'restore' ELSE 'idle' END AS state
       FROM v LEFT JOIN m ON v.event_id = m.event_id"""
)
def sample_state_label(spark, root):
    events = table(spark, root, "events")
    kind = F.when(F.col("event_type") == "purchase", "backup").otherwise("restore")
    spans = events.where(F.col("event_type").isin("purchase", "signup")).select(
        kind.alias("kind"), clock.span_start(F.col("ts"), F.col("value")).alias("start"), F.col("ts").alias("end")
    )
    views = events.where("event_type = 'view'").select("event_id", "ts")
    return asof.state_label(views, spans, "ts", "start", "end", "kind").select("event_id", "state")


@query(
    """WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'signup'),
       s AS (SELECT ts, value FROM events WHERE event_type <> 'signup')
       SELECT p.event_id, coalesce(max(s.value), 0) AS max_value
       FROM p LEFT JOIN s ON s.ts > p.ts AND s.ts < p.ts + INTERVAL 3 HOUR GROUP BY p.event_id"""
)
def post_event_window_max(spark, root):
    events = table(spark, root, "events")
    probes = events.where("event_type = 'signup'").select("event_id", F.col("ts").alias("at"))
    samples = events.where("event_type <> 'signup'").select("ts", "value")
    peaks = intervals.window_peak_after(probes, samples, "event_id", "at", "ts", "value", 3 * 3600)
    return peaks.select("event_id", "max_value")


@query(
    """WITH p AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS probe_at FROM orders)
       SELECT p.probe_at, max(o.o_totalprice) AS peak_price
       FROM p LEFT JOIN orders o ON o.o_orderdate <= p.probe_at GROUP BY p.probe_at"""
)
def asof_running_max(spark, root):
    orders = table(spark, root, "orders").select("o_orderdate", "o_totalprice")
    points = orders.groupBy("o_orderdate").agg(F.max("o_totalprice").alias("top"))
    probes = orders.select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("probe_at")).distinct()
    return asof.asof_peak(points, probes, "o_orderdate", "probe_at", {"peak_price": F.col("top")})


@query(
    """SELECT user_id, n, event_id FROM (
         SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
       WHERE n = user_id % 7 + 1"""
)
def nth_event_lookup(spark, root):
    events = table(spark, root, "events").select("user_id", "ts", "event_id")
    wanted = events.select("user_id").distinct().withColumn("n", F.col("user_id") % 7 + 1)
    return sequence.nth_rows(events, wanted, ["user_id"], ["ts", "event_id"], "n").select("user_id", "n", "event_id")


def _status_sql(source: str) -> str:
    difference = f"coalesce({source}_restored, 0) - {source}_target"
    return (
        f"coalesce({source}_target, 0) AS {source}_target, coalesce({source}_restored, 0) AS {source}_restored, "
        f"CASE WHEN {difference} = 0 THEN '✅ Valid' "
        f"ELSE 'Delta (' || coalesce(CAST({difference} AS VARCHAR), 'nan') || ')' END AS {source}_status"
    )


@query(
    f"""WITH b AS (SELECT 'chain-v' || (user_id % 5 + 1) AS chain, ts,
                     row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n
                  FROM events WHERE event_type = 'click'),
        r AS (SELECT event_id AS restore_id, 'chain-v' || (user_id % 5 + 1) AS chain, event_id % 50 + 1 AS n, ts AS restored_at
              FROM events WHERE event_type = 'signup'),
        j AS (SELECT r.restore_id, r.chain, r.n, b.ts AS backed_up_at, r.restored_at
              FROM r JOIN b ON r.chain = b.chain AND r.n = b.n),
        p AS (SELECT event_type, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events
              WHERE event_type IN ('purchase', 'view', 'error')),
        x AS (SELECT j.restore_id, j.chain, j.n, j.backed_up_at, j.restored_at,
                max(CASE WHEN event_type = 'purchase' AND p.ts <= backed_up_at THEN v END) AS pg_target,
                max(CASE WHEN event_type = 'view' AND p.ts <= backed_up_at THEN v END) AS mongo_target,
                max(CASE WHEN event_type = 'error' AND p.ts <= backed_up_at THEN v END) AS files_target,
                max(CASE WHEN event_type = 'purchase' AND p.ts > restored_at AND p.ts < restored_at + INTERVAL 3 HOUR THEN v END) AS pg_restored,
                max(CASE WHEN event_type = 'view' AND p.ts > restored_at AND p.ts < restored_at + INTERVAL 3 HOUR THEN v END) AS mongo_restored,
                max(CASE WHEN event_type = 'error' AND p.ts > restored_at AND p.ts < restored_at + INTERVAL 3 HOUR THEN v END) AS files_restored
              FROM j CROSS JOIN p GROUP BY ALL)
        SELECT restore_id, chain, 'Cycle ' || n AS target_cycle, strftime(backed_up_at, '%H:%M:%S') AS backup_time,
               strftime(restored_at, '%H:%M:%S') AS restore_time,
               {_status_sql('pg')}, {_status_sql('mongo')}, {_status_sql('files')} FROM x"""
)
def restore_validation(spark, root):
    events = table(spark, root, "events")
    chain = F.concat(F.lit("chain-v"), (F.col("user_id") % 5 + 1).cast("string")).alias("chain")
    backups = events.where("event_type = 'click'").select(chain, F.col("ts").alias("ended_at"), F.col("event_id").alias("cycle_id"))
    restores = events.where("event_type = 'signup'").select(
        F.col("event_id").alias("restore_id"), chain, (F.col("event_id") % 50 + 1).alias("n"), F.col("ts").alias("restored_at")
    )
    names = {"purchase": "pg", "view": "mongo", "error": "files"}
    source = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    points = events.where(F.col("event_type").isin(*names)).select(
        source.alias("source"), "ts", cents("value").alias("value")
    )
    return validation_report(backups, restores, points, list(names.values()), window_seconds=3 * 3600)


_TARGETS_SQL = """t AS (SELECT c_custkey, TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 1500 AS INTEGER)) AS target_at FROM customer),
       o AS (SELECT o_custkey, o_orderdate, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id FROM orders),
       r AS (SELECT t.c_custkey, t.target_at, o.cycle_id,
               row_number() OVER (PARTITION BY t.c_custkey ORDER BY o.o_orderdate DESC, o.cycle_id) AS k
             FROM t LEFT JOIN o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.target_at),
       picked AS (SELECT c_custkey, target_at, cycle_id AS target_cycle FROM r WHERE k = 1)"""


def _orders_as_cycles(spark, root):
    return table(spark, root, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", padded_id("o_orderkey").alias("cycle_id")
    )


def _picked(spark, root):
    day = F.make_dt_interval(F.col("c_custkey") % 1500)
    targets = table(spark, root, "customer").select(
        "c_custkey", (F.lit("1996-01-01").cast("timestamp_ntz") + day).alias("target_at")
    )
    return asof.latest_before(_orders_as_cycles(spark, root), targets, "o_orderdate", "cycle_id", "target_at", ["c_custkey"])


@query(f"WITH {_TARGETS_SQL} SELECT c_custkey, target_at, target_cycle FROM picked")
def latest_before_target(spark, root):
    return _picked(spark, root).select("c_custkey", "target_at", "target_cycle")


@query(
    f"""WITH {_TARGETS_SQL} SELECT p.c_custkey, o.cycle_id FROM picked p
        JOIN o ON o.o_custkey = p.c_custkey AND o.cycle_id <= p.target_cycle"""
)
def replay_prefix(spark, root):
    targets = _picked(spark, root).select("c_custkey", "target_cycle")
    return sequence.replay_prefix(_orders_as_cycles(spark, root), targets, "c_custkey", "cycle_id", "target_cycle").select(
        "c_custkey", "cycle_id"
    )


@query(
    """SELECT c_custkey, cycle_id, replay_order FROM (
         SELECT o_custkey AS c_custkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS replay_order FROM orders)
       WHERE replay_order <= c_custkey % 4 + 1"""
)
def oldest_n_per_chain(spark, root):
    requests = table(spark, root, "customer").select("c_custkey", (F.col("c_custkey") % 4 + 1).alias("n"))
    picked = sequence.oldest_n(_orders_as_cycles(spark, root), requests, "c_custkey", "cycle_id", "n")
    return picked.select("c_custkey", "cycle_id", "replay_order")


@query(
    """SELECT o_orderkey, o_orderstatus,
         coalesce(o_orderstatus <> lag(o_orderstatus) OVER (ORDER BY o_orderkey), false) AS changed,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) = 1 AS is_first
       FROM orders"""
)
def chain_change_flags(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    changed = sequence.change_flag(orders, ["o_orderkey"], "o_orderstatus")
    return sequence.first_flag(changed, ["o_orderstatus"], ["o_orderkey"])


@query(
    """WITH d AS (SELECT l_suppkey, l_shipdate, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS raw_bytes,
                    sum(l_quantity) AS seconds FROM lineitem GROUP BY ALL)
       SELECT l_suppkey, l_shipdate, raw_bytes,
         round(sum(raw_bytes) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) / 1073741824.0, 6) AS cumulative_gib,
         seconds > 20 AS is_slow FROM d"""
)
def cumulative_scaling(spark, root):
    daily = table(spark, root, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(
        F.sum(cents("l_extendedprice")).alias("raw_bytes"), F.sum("l_quantity").alias("seconds")
    )
    summed = sequence.cumulative(daily, ["l_suppkey"], ["l_shipdate"], F.col("raw_bytes"), "cumulative_bytes")
    return summed.select(
        "l_suppkey", "l_shipdate", "raw_bytes",
        F.round(derive.gib(F.col("cumulative_bytes")), 6).alias("cumulative_gib"),
        derive.is_slow(F.col("seconds")).alias("is_slow"),
    )


@query(
    """SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mean2 FROM events"""
)
def rolling_mean2(spark, root):
    events = table(spark, root, "events").select("event_id", "user_id", "ts", "value")
    means = sequence.rolling_pair_mean(events, ["user_id"], ["ts", "event_id"], "value", "mean2")
    return means.select("event_id", "user_id", F.round("mean2", 6).alias("mean2"))


@query(
    """WITH c AS (SELECT event_id, user_id, ts, event_type,
                    sum(CAST(round(value * 100) AS BIGINT)) OVER w AS counted,
                    sum(CASE WHEN event_type IN ('view', 'click') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) OVER w AS idle
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
       d AS (SELECT event_id, user_id, counted - lag(counted) OVER p AS dt, idle - lag(idle) OVER p AS di
             FROM c WHERE event_type = 'error' WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, CASE WHEN dt IS NULL THEN NULL WHEN dt > 0
         THEN round(100.0::DOUBLE * (1.0::DOUBLE - di::DOUBLE / dt::DOUBLE), 2) ELSE 0.0 END AS busy_percent FROM d"""
)
def counter_rate(spark, root):
    events = table(spark, root, "events").select("event_id", "user_id", "ts", "event_type", cents("value").alias("ticks"))
    idle = F.when(F.col("event_type").isin("view", "click"), F.col("ticks")).otherwise(0)
    order = ["ts", "event_id"]
    counters = running(events, ["user_id"], order, {"counted": total(F.col("ticks")), "idle": total(idle)})
    polls = counters.where("event_type = 'error'")
    rated = sequence.counter_rate(polls, ["user_id"], order, "idle", "counted")
    return rated.select("event_id", "user_id", "busy_percent")


@query(
    """WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS slot, max(value) AS value FROM events GROUP BY ALL),
       r AS (SELECT event_type, min(slot) - INTERVAL 3 HOUR AS lo, max(slot) + INTERVAL 3 HOUR AS hi FROM h GROUP BY 1),
       g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS slot FROM r)
       SELECT g.event_type, g.slot, h.value, h.value IS NULL AS is_imputed
       FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.slot = h.slot"""
)
def gap_grid(spark, root):
    events = table(spark, root, "events")
    slot = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot")
    hourly = events.groupBy("event_type", slot).agg(F.max("value").alias("value"))
    bounds = hourly.groupBy("event_type").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    wider = grid.padded(bounds, "lo", "hi", 3600, before=3, after=3)
    slots = grid.regular_grid(wider, "lo", "hi", 3600, ["event_type"])
    return grid.with_gaps(slots, hourly, ["event_type"], "value")


@query(
    """SELECT event_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
         round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct, round(avg(value), 6) AS mean_value
       FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def ops_distribution(spark, root):
    events = table(spark, root, "events").select("event_type", "value")
    shares = frequency.frequency_table(events, "event_type", ascending=True)
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))
    return frequency.aligned_to(means, shares, "event_type").withColumn("pct", F.round("pct", 6))


_FIVE_MINUTES_SQL = """c AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n
       FROM events WHERE event_type IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_FIVE_MINUTES_SQL} SELECT bucket, event_type, n FROM c")
def ops_per_5min(spark, root):
    return frequency.bucket_counts(table(spark, root, "events"), "ts", "event_type")


@query(
    f"""WITH {_FIVE_MINUTES_SQL},
        r AS (SELECT event_type, min(bucket) AS lo, max(bucket) AS hi FROM c GROUP BY 1),
        g AS (SELECT DISTINCT unnest(generate_series(lo, hi, INTERVAL 5 MINUTE)) AS bucket FROM r)
        SELECT g.bucket, {', '.join(f"CAST(coalesce(sum(n) FILTER (event_type = '{t}'), 0) AS BIGINT) AS {t}" for t in EVENT_TYPES)}
        FROM g LEFT JOIN c ON g.bucket = c.bucket GROUP BY g.bucket"""
)
def ops_per_5min_wide(spark, root):
    counts = frequency.bucket_counts(table(spark, root, "events"), "ts", "event_type")
    return frequency.wide_counts(counts, "event_type", EVENT_TYPES)


@query(
    """WITH b AS (SELECT min(ts) FILTER (event_type = 'purchase') - INTERVAL 2 MINUTE AS lo,
                    max(ts) FILTER (event_type = 'purchase') + INTERVAL 2 MINUTE AS hi,
                    min(ts) FILTER (event_type = 'purchase') + INTERVAL 10 DAY AS brk FROM events)
       SELECT event_type, CASE WHEN ts <= brk THEN 'left' ELSE 'right' END AS panel, count(*) AS n,
         min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value
       FROM events, b WHERE ts BETWEEN lo AND hi GROUP BY ALL"""
)
def event_window_filter(spark, root):
    events = table(spark, root, "events").select("event_type", "ts", "value")
    bought = events.where("event_type = 'purchase'")
    bounds = bought.agg(F.struct(F.min("ts").alias("first"), F.max("ts").alias("last"))).scalar()
    margin = clock.seconds(F.lit(120))
    inside = events.where(F.col("ts").between(bounds["first"] - margin, bounds["last"] + margin))
    break_at = bounds["first"] + clock.seconds(F.lit(10 * 86400))
    panel = F.when(F.col("ts") <= break_at, "left").otherwise("right")
    return inside.groupBy("event_type", panel.alias("panel")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.round(F.avg("value"), 6).alias("avg_value"),
    )
