"""Reports over the telemetry schemas. Each returns a frame in report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.functions import clock, derive, text
from cycle_analytics.operators import asof, frequency, grid, integrity, intervals, sequence, significance
from cycle_analytics.session import is_small, written

BACKUP_ORDER = ["ended_at", "cycle_id"]

# Stages and byte columns that the reports list.
CYCLE_STAGES = [
    "unstructured_chunk_s", "unstr_base_s", "transfer_s", "verify_s", "mongo_oplog_extract_s", "pg_basebackup_s",
]
RESTORE_STAGES = ["unstructured_restore_s", "pg_wal_stage_s", "verify_s"]
RESTORED_BYTES = [
    "unstructured_restored_raw_bytes", "pg_wal_restored_raw_bytes", "pg_basebackup_restored_raw_bytes",
    "mongo_oplog_restored_raw_bytes", "mongo_basebackup_restored_raw_bytes",
]


def cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def cycle_durations(backups: DataFrame) -> DataFrame:
    """Stages, residual and chain changes per cycle."""
    rest = derive.residual(F.col("total_cycle_s"), *cols(CYCLE_STAGES))
    flagged = sequence.change_flag(backups, BACKUP_ORDER, "chain_version", "chain_changed")
    return flagged.select(
        "chain_version", "cycle_id", clock.hour_minute(F.col("ended_at")).alias("clock"), *CYCLE_STAGES,
        rest.alias("other_stages_s"), "total_cycle_s", "chain_changed",
    ).orderBy("cycle_id")


def cycle_volumes(backups: DataFrame) -> DataFrame:
    """Raw and transferred MiB per cycle, with its label inside the chain."""
    numbered = sequence.numbered(backups, ["chain_version"], BACKUP_ORDER, "cycle_n")
    return numbered.select(
        "chain_version", "cycle_id", "cycle_n",
        derive.cycle_label(F.col("chain_version"), F.col("cycle_n")).alias("label"),
        derive.mib(F.col("cycle_raw_total_size")).alias("raw_mib"),
        derive.mib(F.col("cycle_final_transfered_size")).alias("transferred_mib"),
    ).orderBy("cycle_id")


def restore_composition(restores: DataFrame) -> DataFrame:
    """Restore stages, residual and restored GiB per chain."""
    return restores.select(
        "target_chain_version", *RESTORE_STAGES,
        derive.residual(F.col("total_restore_s"), *cols(RESTORE_STAGES)).alias("other_s"),
        "total_restore_s",
        derive.gib(derive.row_sum(*cols(RESTORED_BYTES))).alias("restored_gib"),
    )


def workflow_throughput(workflows: DataFrame) -> DataFrame:
    """Package size over total workflow time, numbered per workflow type and chain."""
    numbered = sequence.numbered(workflows, ["workflow_type", "chain_v"], BACKUP_ORDER, "cycle_n")
    size = derive.mib(F.col("raw_size_bytes"))
    return numbered.select(
        "workflow_type", "chain_v", "cycle_id", "cycle_n",
        F.concat("chain_v", F.lit("-C"), F.col("cycle_n").cast("string")).alias("label"),
        F.col("raw_size_bytes").alias("package_bytes"), size.alias("package_mib"),
        derive.per_second(size, F.col("total_workflow_sec")).alias("throughput_mib_s"),
    )


def throughput_test(spark: SparkSession, workflows: DataFrame) -> DataFrame:
    """Welch's test of backup against restore throughput. The two read different sources."""
    rates = workflow_throughput(workflows)
    tested = significance.welch(rates, "workflow_type", "throughput_mib_s", "backup", "restore")
    return significance.welch_with_p(tested)


def event_spans(df: DataFrame, duration: str, kind: Column, label: Column) -> DataFrame:
    """Spans of recorded events from their end stamp and duration."""
    return df.select(
        label.alias("label"), kind.alias("kind"),
        clock.span_start(F.col("ended_at"), F.col(duration)).alias("start"), F.col("ended_at").alias("end"),
    )


def usage_timeline(
    samples: DataFrame, spans: DataFrame, ts: str, value: str, kind: str | None = None,
    margin_seconds: int = 120, step_seconds: int = 42, before: int = 0, after: int = 0,
) -> DataFrame:
    """Samples labelled by running event, smoothed over two rows, with flagged empty slots around.

    With `kind` only the stretch from its first to its last event, plus the margin.
    """
    if kind:
        chosen = spans.where(F.col("kind") == kind)
        margin = clock.seconds(F.lit(margin_seconds))
        bounds = chosen.agg(F.struct(F.min("start").alias("first"), F.max("end").alias("last"))).scalar()
        samples = samples.where(F.col(ts).between(bounds["first"] - margin, bounds["last"] + margin))
    labelled = asof.state_label(samples, spans, ts, "start", "end", "kind").select(F.col(ts).alias("slot"), value, "state")
    smooth = sequence.rolling_pair_mean(labelled, [], ["slot"], value, "smoothed")
    if not before and not after:
        return smooth.withColumn("is_imputed", F.lit(False))
    bounds = samples.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    step = F.expr(f"interval {step_seconds} seconds")
    head = bounds.select(F.explode(F.sequence(F.col("lo") - step * before, F.col("lo") - step, step)).alias("slot")) if before else bounds.select(F.col("lo").alias("slot")).limit(0)
    tail = bounds.select(F.explode(F.sequence(F.col("hi") + step, F.col("hi") + step * after, step)).alias("slot")) if after else bounds.select(F.col("lo").alias("slot")).limit(0)
    extra = [part.withColumn("state", F.lit("idle")).withColumn("smoothed", F.lit(None).cast("double")) for part in (head, tail)]
    return grid.around(smooth, extra[0], extra[1], value)


def growth(snapshots: DataFrame, total: str, restores: DataFrame, until: Column | None = None, window_seconds: float = 180) -> tuple[DataFrame, DataFrame]:
    """A store's totals up to a cut, and the level each restore brought back (dropped without a sample)."""
    series = snapshots.where(F.col("ts") <= until) if until is not None else snapshots
    name = F.concat_ws("/", "target_chain_version", F.col("ended_at").cast("string"))
    probes = restores.select("target_chain_version", "ended_at", name.alias("restore_id"))
    levels = intervals.window_peak_after(
        probes, snapshots, "restore_id", "ended_at", "ts", total, window_seconds, empty_as_zero=False
    )
    return series.select("ts", total), levels.select("target_chain_version", "ended_at", F.col("max_value").alias("restored_level"))


def split_panels(snapshots: DataFrame, break_at: Column, end_at: Column) -> DataFrame:
    """Rows up to the break, and rows after it up to the end."""
    ts = F.col("ts")
    return snapshots.withColumn(
        "panel", F.when(ts <= break_at, "left").when((ts > break_at) & (ts <= end_at), "right")
    ).where("panel is not null")


def restore_validation(
    backups: DataFrame, restores: DataFrame, points: DataFrame, sources: list[str], window_seconds: float = 180,
) -> DataFrame:
    """Level of each source when the restored cycle was taken, against the level after the restore.

    backups: chain, ended_at, cycle_id; restores: restore_id, chain, n, restored_at;
    points: source, ts, value. Restores of more cycles than the chain has are left out.
    """
    taken = sequence.nth_rows(backups, restores, ["chain"], ["ended_at", "cycle_id"], "n").select(
        "restore_id", "chain", "n", F.col("ended_at").alias("backed_up_at"), "restored_at"
    )
    probes = taken.withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources]))).withColumn(
        "probe_id", F.concat_ws("/", F.col("restore_id").cast("string"), "source")
    )
    targets = asof.asof_peak(points, probes, "ts", "backed_up_at", {"target": F.col("value")}, ["source"])
    levels = intervals.window_peak_after(
        targets, points, "probe_id", "restored_at", "ts", "value", window_seconds, ["source"]
    )
    status = derive.restore_status(F.col("max_value") - F.col("target"))
    rows = levels.select(
        "restore_id", "chain", "n", "backed_up_at", "restored_at", "source",
        F.coalesce("target", F.lit(0)).alias("target"), F.col("max_value").alias("restored"), status.alias("status"),
    )
    wide = rows.groupBy("restore_id", "chain", "n", "backed_up_at", "restored_at").pivot("source", sources).agg(
        F.first("target").alias("target"), F.first("restored").alias("restored"), F.first("status").alias("status")
    )
    return wide.select(
        "restore_id", "chain", F.concat(F.lit("Cycle "), F.col("n").cast("string")).alias("target_cycle"),
        clock.time_of_day(F.col("backed_up_at")).alias("backup_time"),
        clock.time_of_day(F.col("restored_at")).alias("restore_time"),
        *[F.col(f"{s}_{part}") for s in sources for part in ("target", "restored", "status")],
    )


def engine_columns() -> dict[str, Column]:
    """Derived columns of the engine matrices, in report order."""
    c = F.col

    def saved(stored: Column, raw: Column) -> Column:
        return derive.efficiency(stored, raw)

    pg_raw, pg_sent = c("pg_raw_size") + c("pg_wal_raw_bytes"), c("pg_compressed_size") + c("pg_wal_stored_bytes")
    raw = pg_raw + c("mongo_raw_size") + c("unstr_raw_size")
    sent = pg_sent + c("mongo_compressed_size") + c("unstr_compressed_size")
    return {
        "pg_base_raw": c("pg_raw_size"),
        "pg_base_stored": c("pg_compressed_size"),
        "pg_base_eff_pct": saved(c("pg_compressed_size"), c("pg_raw_size")),
        "pg_wal_raw": c("pg_wal_raw_bytes"),
        "pg_wal_stored": c("pg_wal_stored_bytes"),
        "pg_wal_eff_pct": saved(c("pg_wal_stored_bytes"), c("pg_wal_raw_bytes")),
        "pg_total_raw": pg_raw,
        "pg_total_stored": pg_sent,
        "pg_total_eff_pct": saved(pg_sent, pg_raw),
        "pg_time_s": c("pg_basebackup_s") + c("pg_wal_extract_s") + c("pg_wal_compress_s"),
        "wal_files": c("wal_file_count"),
        "mongo_base_raw": c("mongo_basebackup_raw_bytes"),
        "mongo_oplog_raw": c("mongo_oplog_raw_bytes"),
        "mongo_oplog_stored": c("mongo_oplog_stored_bytes"),
        "mongo_oplog_eff_pct": saved(c("mongo_oplog_stored_bytes"), c("mongo_oplog_raw_bytes")),
        "mongo_total_raw": c("mongo_raw_size"),
        "mongo_total_stored": c("mongo_compressed_size"),
        "mongo_total_eff_pct": saved(c("mongo_compressed_size"), c("mongo_raw_size")),
        "mongo_time_s": c("mongo_basebackup_s") + c("mongo_oplog_extract_s") + c("mongo_oplog_compress_s"),
        "unstr_base_raw": c("unstr_base_size"),
        "unstr_delta_raw": c("unstructured_raw_bytes"),
        "unstr_delta_stored": c("unstructured_stored_bytes"),
        "unstr_delta_eff_pct": saved(c("unstructured_stored_bytes"), c("unstructured_raw_bytes")),
        "unstr_total_raw": c("unstr_raw_size"),
        "unstr_total_stored": c("unstr_compressed_size"),
        "unstr_total_eff_pct": saved(c("unstr_compressed_size"), c("unstr_raw_size")),
        "unstr_time_s": c("unstructured_chunk_s") + c("unstr_base_s") + c("unstructured_delta_compress_s"),
        "chunks": c("pfc_chunk_count"),
        "total_raw": raw,
        "total_sent": sent,
        "total_eff_pct": saved(sent, raw),
        "net_time_s": c("transfer_s"),
        "total_time_s": c("total_cycle_s"),
    }


def engine_matrix(backups: DataFrame, engine: str | None = None) -> DataFrame:
    """Per-cycle efficiency of all engines, or of `pg`, `mongo` or `unstr` only."""
    numbered = sequence.numbered(backups, ["chain_version"], BACKUP_ORDER, "cycle_n")
    columns = engine_columns()
    if engine:
        extra = {"pg": "wal_files", "unstr": "chunks"}.get(engine)
        columns = {n: v for n, v in columns.items() if n.startswith(f"{engine}_") or n == extra}
    return numbered.select(
        "chain_version", derive.cycle_name(F.col("cycle_n")).alias("cycle_name"), *[v.alias(n) for n, v in columns.items()]
    )


def engine_checks() -> dict[str, tuple[Column, Column]]:
    """Recorded totals against sums of independently recorded parts."""
    c = F.col
    parts = c("pg_compressed_size") + c("pg_wal_stored_bytes") + c("mongo_compressed_size") + c("unstr_compressed_size")
    return {
        "unstr_total_raw": (c("unstr_raw_size"), c("unstr_base_size") + c("unstructured_raw_bytes")),
        "mongo_total_raw": (c("mongo_raw_size"), c("mongo_basebackup_raw_bytes") + c("mongo_oplog_raw_bytes")),
        "transferred": (c("cycle_final_transfered_size"), c("cycle_total_stored_bytes")),
        "stored_parts": (c("cycle_total_stored_bytes"), parts),
    }


def engine_audit(backups: DataFrame) -> DataFrame:
    return integrity.audit_counts(backups, engine_checks())


def engine_offenders(backups: DataFrame) -> DataFrame:
    return integrity.offenders(backups, engine_checks()).select("chain_version", "cycle_id", "check", "recorded", "computed")


def operation_distribution(log: DataFrame, until: Column) -> DataFrame:
    return frequency.frequency_table(log.where(F.col("ts") <= until), "action")


def operation_rate(log: DataFrame, until: Column, actions: list[str]) -> DataFrame:
    return frequency.wide_counts(frequency.bucket_counts(log.where(F.col("ts") <= until), "ts", "action"), "action", actions)


def transfer_table(workflows: DataFrame) -> DataFrame:
    """Formatted upload table of the backups: cycle, bytes, MiB, seconds, MiB/s."""
    numbered = sequence.numbered(
        workflows.where(F.col("workflow_type") == "backup"), ["chain_v"], BACKUP_ORDER, "cycle_n"
    )
    size, took = derive.mib(F.col("raw_size_bytes")), F.col("duration_cloud_transfer_sec")
    return numbered.select(
        derive.cycle_label(F.col("chain_v"), F.col("cycle_n")).alias("cycle"),
        text.thousands(F.col("raw_size_bytes")).alias("bytes"),
        text.thousands(size, 2).alias("mib"),
        text.thousands(took, 2).alias("seconds"),
        text.thousands(derive.per_second(size, took), 2).alias("mib_s"),
    )


def resource_stats(
    events: DataFrame, duration: str, chain: str, prefix: str, samples: dict[str, tuple[DataFrame, str]], margin_seconds: float
) -> DataFrame:
    """Peak and mean of each metric while an event ran, with a margin on both sides."""
    out = sequence.numbered(events, [chain], BACKUP_ORDER, "cycle_n").select(
        F.concat(F.lit(prefix), derive.cycle_label(F.col(chain), F.col("cycle_n"))).alias("name"),
        F.col(duration).alias("duration_s"),
        clock.span_start(F.col("ended_at"), F.col(duration)).alias("start"), F.col("ended_at").alias("end"),
    )
    if not is_small(out):
        out = written(out, "event-spans")
    margin, bounds = clock.seconds(F.lit(margin_seconds)), out
    for metric, (frame, value) in samples.items():
        out = intervals.span_stats(
            out, frame, "name", F.col("start") - margin, F.col("end") + margin, "ts", value, width_seconds=600, bounds=bounds
        ).withColumnsRenamed(
            {"n_samples": f"{metric}_n", "max_value": f"{metric}_max", "avg_value": f"{metric}_avg"}
        )
    return out.drop("start", "end")


def primary_metrics(cpu: DataFrame, ram: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """CPU and RAM percentages of the primary host from its wide charts."""
    busy = derive.cpu_percent(*cols(["user", "system", "softirq", "iowait"]))
    used = derive.used_percent(*cols(["used", "free", "cached", "buffers"]))
    return {"cpu": (cpu.select("ts", busy.alias("cpu_pct")), "cpu_pct"), "ram": (ram.select("ts", used.alias("mem_pct")), "mem_pct")}


def monitor_metrics(monitor: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """CPU and RAM percentages of the backup host from its JSON samples."""
    flat = monitor.select("ts", F.col("cpu_percent").alias("cpu_pct"), F.col("memory.percent_used").alias("mem_pct"))
    return {"cpu": (flat.select("ts", "cpu_pct"), "cpu_pct"), "ram": (flat.select("ts", "mem_pct"), "mem_pct")}


def scalability(cycles: DataFrame) -> DataFrame:
    """Cumulative raw GiB against time and rate per chain; `cycles` has chain, cycle, raw_size, time, rate."""
    summed = sequence.cumulative(cycles, ["chain"], ["cycle"], F.col("raw_size"), "cumulative_bytes")
    return summed.select(
        "chain", "cycle", derive.gib(F.col("cumulative_bytes")).alias("cumulative_gib"), "time", "rate",
        derive.is_slow(F.col("time")).alias("is_slow"),
    )
