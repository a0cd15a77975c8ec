"""Queries on derivations, aggregates and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cycle_analytics.functions import derive, text
from cycle_analytics.operators import integrity, reshape, sequence, significance
from cycle_analytics.plans.registry import cents, query
from cycle_analytics.sources.tables import table

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS} AS total_s,
          CAST(round({_CENTS} * l_discount) AS BIGINT) AS discount_s, CAST(round({_CENTS} * l_tax) AS BIGINT) AS tax_s,
          {_CENTS} - CAST(round({_CENTS} * l_discount) AS BIGINT) - CAST(round({_CENTS} * l_tax) AS BIGINT) AS other_s
        FROM lineitem"""
)
def stage_breakdown(spark, root):
    price = cents("l_extendedprice")
    staged = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("total_s"),
        F.round(price * F.col("l_discount")).cast("bigint").alias("discount_s"),
        F.round(price * F.col("l_tax")).cast("bigint").alias("tax_s"),
    )
    return staged.withColumn("other_s", derive.residual(F.col("total_s"), F.col("discount_s"), F.col("tax_s")))


_PIECES = f"""p AS (SELECT l_returnflag, l_linestatus, l_linenumber = 1 AS is_base,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0 ELSE {_CENTS} END AS raw,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 0 ELSE CAST(round({_CENTS} * (1 - l_discount)) AS BIGINT) END AS stored
       FROM lineitem)"""


def _eff(stored: str, raw: str) -> str:
    return f"CASE WHEN {raw} = 0 AND {stored} = 0 THEN 0.0 ELSE round((1 - {stored}::DOUBLE / nullif({raw}, 0)::DOUBLE) * 100, 6) END"


@query(
    f"""WITH {_PIECES}, s AS (SELECT l_returnflag, l_linestatus,
          CAST(sum(CASE WHEN is_base THEN raw ELSE 0 END) AS BIGINT) AS base_raw,
          CAST(sum(CASE WHEN is_base THEN stored ELSE 0 END) AS BIGINT) AS base_stored,
          CAST(sum(CASE WHEN is_base THEN 0 ELSE raw END) AS BIGINT) AS delta_raw,
          CAST(sum(CASE WHEN is_base THEN 0 ELSE stored END) AS BIGINT) AS delta_stored FROM p GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, base_raw, base_stored, {_eff('base_stored', 'base_raw')} AS base_eff_pct,
          base_raw = 0 AND base_stored <> 0 AS base_undefined,
          delta_raw, delta_stored, {_eff('delta_stored', 'delta_raw')} AS delta_eff_pct,
          base_raw + delta_raw AS total_raw, base_stored + delta_stored AS total_stored,
          {_eff('(base_stored + delta_stored)', '(base_raw + delta_raw)')} AS total_eff_pct FROM s"""
)
def efficiency_matrix(spark, root):
    lines = table(spark, root, "lineitem")
    price = cents("l_extendedprice")
    empty = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    base = F.col("l_linenumber") == 1
    raw = F.when(empty | ((F.col("l_returnflag") == "R") & base), 0).otherwise(price)
    stored = F.when(empty, 0).otherwise(F.round(price * (1 - F.col("l_discount"))).cast("bigint"))
    sums = lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.when(base, raw).otherwise(0)).alias("base_raw"), F.sum(F.when(base, stored).otherwise(0)).alias("base_stored"),
        F.sum(F.when(base, 0).otherwise(raw)).alias("delta_raw"), F.sum(F.when(base, 0).otherwise(stored)).alias("delta_stored"),
    )
    c = F.col
    total_raw, total_stored = c("base_raw") + c("delta_raw"), c("base_stored") + c("delta_stored")

    def eff(s, r, name):
        return F.round(derive.efficiency(s, r), 6).alias(name)

    return sums.select(
        "l_returnflag", "l_linestatus", "base_raw", "base_stored", eff(c("base_stored"), c("base_raw"), "base_eff_pct"),
        derive.ratio_undefined(c("base_stored"), c("base_raw")).alias("base_undefined"),
        "delta_raw", "delta_stored", eff(c("delta_stored"), c("delta_raw"), "delta_eff_pct"),
        total_raw.alias("total_raw"), total_stored.alias("total_stored"), eff(total_stored, total_raw, "total_eff_pct"),
    )


_MONTHLY = f"""m AS (SELECT l_returnflag, date_trunc('month', l_shipdate)::TIMESTAMP AS month,
         CAST(sum({_CENTS}) AS BIGINT) AS bytes, sum(l_quantity) AS seconds FROM lineitem GROUP BY ALL),
       n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY month) AS cycle_n FROM m)"""


def _monthly(spark, root):
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")
    sums = table(spark, root, "lineitem").groupBy("l_returnflag", month).agg(
        F.sum(cents("l_extendedprice")).alias("bytes"), F.sum("l_quantity").alias("seconds")
    )
    return sequence.numbered(sums, ["l_returnflag"], ["month"], "cycle_n")


@query(
    f"""WITH {_MONTHLY} SELECT l_returnflag || ' C' || cycle_n AS label, bytes,
          round(bytes / 1048576.0 / seconds, 6) AS mib_s, round(bytes / seconds, 4) AS byte_s
        FROM n WHERE l_returnflag IN ('A', 'R')"""
)
def throughput_by_workflow(spark, root):
    kept = _monthly(spark, root).where(F.col("l_returnflag").isin("A", "R"))
    size, took = F.col("bytes"), F.col("seconds")
    return kept.select(
        F.concat("l_returnflag", F.lit(" C"), F.col("cycle_n").cast("string")).alias("label"), "bytes",
        F.round(derive.per_second(derive.mib(size), took), 6).alias("mib_s"),
        F.round(derive.per_second(size, took), 4).alias("byte_s"),
    )


@query(
    f"""WITH {_MONTHLY} SELECT replace('chain-' || l_returnflag, 'chain-', '') || '-C' || cycle_n AS cycle,
          format('{{:,}}', bytes) AS bytes, format('{{:,.2f}}', bytes / 1048576.0::DOUBLE) AS mib,
          format('{{:,.2f}}', seconds) AS seconds, format('{{:,.2f}}', bytes / 1048576.0::DOUBLE / seconds) AS mib_s,
          strftime(month, '%H:%M') AS clock FROM n"""
)
def formatted_transfer_table(spark, root):
    size, took = derive.mib(F.col("bytes")), F.col("seconds")
    return _monthly(spark, root).select(
        derive.cycle_label(F.concat(F.lit("chain-"), "l_returnflag"), F.col("cycle_n")).alias("cycle"),
        text.thousands(F.col("bytes")).alias("bytes"), text.thousands(size, 2).alias("mib"),
        text.thousands(took, 2).alias("seconds"), text.thousands(derive.per_second(size, took), 2).alias("mib_s"),
        F.date_format("month", "HH:mm").alias("clock"),
    )


@query(
    """WITH m AS (SELECT count(value) FILTER (event_type = 'view') AS n_1, avg(value) FILTER (event_type = 'view') AS mean_1,
           var_samp(value) FILTER (event_type = 'view') AS v1, count(value) FILTER (event_type = 'purchase') AS n_2,
           avg(value) FILTER (event_type = 'purchase') AS mean_2, var_samp(value) FILTER (event_type = 'purchase') AS v2 FROM events)
       SELECT n_1, round(mean_1, 6) AS mean_1, n_2, round(mean_2, 6) AS mean_2,
         round((mean_1 - mean_2) / sqrt(v1 / n_1 + v2 / n_2), 6) AS t,
         round((v1 / n_1 + v2 / n_2) ** 2 / ((v1 / n_1) ** 2 / (n_1 - 1) + (v2 / n_2) ** 2 / (n_2 - 1)), 4) AS df FROM m"""
)
def welch_ttest(spark, root):
    tested = significance.welch(table(spark, root, "events"), "event_type", "value", "view", "purchase")
    digits = {"mean_1": 6, "mean_2": 6, "t": 6, "df": 4}
    return tested.withColumns({name: F.round(name, n) for name, n in digits.items()})


def _welch_sql(keys: str) -> str:
    """Welch's test by key; p by Simpson's rule over the density of t, in 4,000 steps."""
    k = f"{keys}, " if keys else ""
    return f"""m AS (SELECT {k}count(value) FILTER (event_type = 'view') AS n_1, avg(value) FILTER (event_type = 'view') AS mean_1,
           var_samp(value) FILTER (event_type = 'view') AS s1, count(value) FILTER (event_type = 'purchase') AS n_2,
           avg(value) FILTER (event_type = 'purchase') AS mean_2, var_samp(value) FILTER (event_type = 'purchase') AS s2 FROM e{' GROUP BY ' + keys if keys else ''}),
       w AS (SELECT *, s1 / n_1 AS e1, s2 / n_2 AS e2 FROM m),
       t AS (SELECT *, (mean_1 - mean_2) / sqrt(e1 + e2) AS t, (e1 + e2) ** 2 / (e1 ** 2 / (n_1 - 1) + e2 ** 2 / (n_2 - 1)) AS v FROM w),
       d AS (SELECT *, abs(t) / 4000 AS h, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) AS c FROM t),
       p AS (SELECT {k}n_1, mean_1, n_2, mean_2, t, v, 1 - 2 * sum(c * (1 + (i * h) ** 2 / v) ** (-(v + 1) / 2) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value(h) / 3 AS p
             FROM d, range(4001) AS places(i) GROUP BY ALL)
       SELECT {k}n_1, round(mean_1, 6) AS mean_1, n_2, round(mean_2, 6) AS mean_2, round(t, 6) AS t, round(v, 4) AS df, round(p, 8) AS p, p < 0.05 AS significant FROM p"""


def _rounded_test(tested):
    digits = {"mean_1": 6, "mean_2": 6, "t": 6, "df": 4, "p": 8}
    return tested.withColumns({name: F.round(name, n) for name, n in digits.items()})


@query(f"WITH e AS (SELECT * FROM events), {_welch_sql('')}")
def welch_p_value(spark, root):
    tested = significance.welch(table(spark, root, "events"), "event_type", "value", "view", "purchase")
    return _rounded_test(significance.welch_with_p(tested))


@query(f"WITH e AS (SELECT *, user_id % 50 AS cohort FROM events), {_welch_sql('cohort')}")
def welch_ttest_groups(spark, root):
    """The same test for every cohort, with its p-value, in one pass."""
    events = table(spark, root, "events").withColumn("cohort", F.col("user_id") % 50)
    tested = significance.welch(events, "event_type", "value", "view", "purchase", ["cohort"])
    return _rounded_test(significance.welch_with_p(tested))


_AUDIT = f"""l AS (SELECT l_orderkey, CAST(sum({_CENTS}) AS BIGINT) AS priced, count(*) AS n_lines, max(l_linenumber) AS last_line
         FROM lineitem GROUP BY 1),
       a AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS recorded, coalesce(priced, 0) AS priced,
         coalesce(n_lines, 0) AS n_lines, coalesce(last_line, 0) AS last_line FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)"""


def _audited(spark, root):
    lines = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(cents("l_extendedprice")).alias("priced"), F.count(F.lit(1)).alias("n_lines"),
        F.max("l_linenumber").cast("bigint").alias("last_line"),
    )
    orders = table(spark, root, "orders").select("o_orderkey", cents("o_totalprice").alias("recorded"))
    return orders.join(lines, "o_orderkey", "left").fillna(0, ["priced", "n_lines", "last_line"])


def _checks():
    return {
        "total": (F.col("recorded"), F.col("priced")),
        "line_count": (F.col("last_line"), F.col("n_lines")),
    }


@query(
    f"""WITH {_AUDIT} SELECT count(*) AS rows, count(*) FILTER (recorded <> priced) AS total,
          count(*) FILTER (last_line <> n_lines) AS line_count FROM a"""
)
def total_audit(spark, root):
    return integrity.audit_counts(_audited(spark, root), _checks())


@query(
    f"""WITH {_AUDIT} SELECT o_orderkey, 'total' AS "check", recorded::DOUBLE AS recorded, priced::DOUBLE AS computed FROM a WHERE recorded <> priced
        UNION ALL SELECT o_orderkey, 'line_count', last_line::DOUBLE, n_lines::DOUBLE FROM a WHERE last_line <> n_lines"""
)
def audit_offenders(spark, root):
    return integrity.offenders(_audited(spark, root), _checks()).select(
        "o_orderkey", "check", "recorded", "computed"
    )


@query(
    """WITH x AS (SELECT year(l_shipdate) AS year, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
       u AS (SELECT year, 'quantity' AS dim, 'packets per second' AS unit, l_quantity AS value FROM x
         UNION ALL SELECT year, 'price', 'mebibytes', l_extendedprice FROM x
         UNION ALL SELECT year, 'discount', 'percent', l_discount FROM x UNION ALL SELECT year, 'tax', 'ratio', l_tax FROM x),
       s AS (SELECT year, dim, CASE unit WHEN 'packets per second' THEN 'K packets/s' WHEN 'mebibytes' THEN 'GiBy' WHEN 'percent' THEN '%' ELSE unit END AS shown_unit,
         round(value / CASE unit WHEN 'packets per second' THEN 1000.0 WHEN 'mebibytes' THEN 1024.0 ELSE 1.0 END::DOUBLE, 4) AS v, value FROM u)
       SELECT CAST(year AS BIGINT) AS year, dim, shown_unit, count(*) AS n, max(v) AS max_value,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum_cents FROM s GROUP BY ALL"""
)
def wide_to_long(spark, root):
    lines = table(spark, root, "lineitem").select(
        F.year("l_shipdate").cast("bigint").alias("year"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    dims = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}
    units = {"l_quantity": "packets per second", "l_extendedprice": "mebibytes", "l_discount": "percent", "l_tax": "ratio"}
    long = reshape.wide_to_long(lines, ["year"], dims, units)
    shown = reshape.shown(long, reshape.unit_table(spark))
    return shown.groupBy("year", "dim", "shown_unit").agg(
        F.count(F.lit(1)).alias("n"), F.max("shown_value").alias("max_value"),
        F.sum(cents("value")).alias("sum_cents"),
    )


@query(
    """WITH p AS (SELECT l_linestatus, l_returnflag, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 ELSE 1 END AS k,
           CAST(round(l_quantity) AS BIGINT) AS q, l_linenumber AS f FROM lineitem),
       s AS (SELECT l_returnflag, l_linestatus, CAST(sum(k * q) AS BIGINT) AS used, CAST(sum(k * f) AS BIGINT) AS free, CAST(sum(k * 2) AS BIGINT) AS cached,
           CAST(sum(k) AS BIGINT) AS buffers FROM p GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, CAST(used + free + cached + buffers AS DOUBLE) AS cpu_pct,
         round(used::DOUBLE / nullif(used + free + cached + buffers, 0) * 100, 6) AS mem_pct,
         CASE WHEN used + free > 0 THEN round(used::DOUBLE / (used + free) * 100, 2) ELSE 0.0 END AS gauge_pct FROM s"""
)
def utilisation_percent(spark, root):
    empty = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    weight = F.when(empty, 0).otherwise(1)
    parts = table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(weight * F.round("l_quantity").cast("bigint")).alias("used"), F.sum(weight * F.col("l_linenumber")).alias("free"),
        F.sum(weight * 2).alias("cached"), F.sum(weight).alias("buffers"),
    )
    used, free, cached, buffers = (F.col(c) for c in ("used", "free", "cached", "buffers"))
    return parts.select(
        "l_returnflag", "l_linestatus", derive.cpu_percent(used, free, cached, buffers).cast("double").alias("cpu_pct"),
        F.round(derive.used_percent(used, free, cached, buffers), 6).alias("mem_pct"),
        derive.gauge_percent(used, used + free).alias("gauge_pct"),
    )


@query("SELECT event_id, greatest(least(value, 13.0::DOUBLE), 2.0::DOUBLE) AS clipped FROM events")
def clip_values(spark, root):
    return table(spark, root, "events").select("event_id", derive.clip(F.col("value"), 2.0, 13.0).alias("clipped"))


@query(
    """SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key')) AS BIGINT) AS k,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 0
           THEN round(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 * 100, 2) ELSE 0.0 END AS percent_used FROM events"""
)
def nested_json_extract(spark, root):
    parsed = table(spark, root, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key")).try_cast("bigint").alias("k"),
        F.from_json("props", "k bigint").alias("memory"),
    )
    return parsed.select("event_id", "k", derive.gauge_percent(F.col("memory.k").cast("double"), F.when(F.col("memory.k") > 0, 100.0).otherwise(0.0)).alias("percent_used"))


# Label and capacity of each chain, in declared order.
CHAIN_LABELS = [("click", "chain-v1", 1), ("error", "chain-v2", 2), ("purchase", "chain-v3", 3), ("signup", "chain-v4", 4), ("view", "chain-v5", 5)]


@query(
    f"""WITH v(event_type, chain, weight) AS (VALUES {', '.join(str(r) for r in CHAIN_LABELS)}),
       d AS (SELECT v.chain, date_trunc('day', e.ts)::TIMESTAMP AS cycle, CAST(sum(v.weight * CAST(round(e.value * 100) AS BIGINT)) AS BIGINT) AS raw_size
             FROM events e JOIN v USING (event_type) GROUP BY ALL)
       SELECT chain, cycle, raw_size, CAST(sum(raw_size) OVER (PARTITION BY chain ORDER BY cycle) AS BIGINT) AS cumulative_bytes FROM d"""
)
def literal_cumulative(spark, root):
    labels = spark.createDataFrame(CHAIN_LABELS, "event_type string, chain string, weight int")
    events = table(spark, root, "events").select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("cycle"), cents("value").alias("size"))
    # Daily sums first, so the five-row table meets one row per type and day.
    daily = events.groupBy("event_type", "cycle").agg(F.sum("size").alias("size"))
    sized = daily.join(F.broadcast(labels), "event_type").select("chain", "cycle", (F.col("size") * F.col("weight")).alias("raw_size"))
    return sequence.cumulative(sized, ["chain"], ["cycle"], F.col("raw_size"), "cumulative_bytes")
