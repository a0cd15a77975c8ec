"""Restore plans and the restore pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.functions import crypto, text
from cycle_analytics.functions.clock import instant
from cycle_analytics.operators import integrity, sequence
from cycle_analytics.operators.asof import latest_before
from cycle_analytics.operators.ledger import valid_catalog
from cycle_analytics.sources.sinks import append_csv, replace_partitions

FILE = ["chain_v", "cycle_id", "rel_path"]
IDENTITY = [*FILE, "chunk_no"]


def restore_plan(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Valid requests to their ordered cycles, with available and selected counts.

    No artifact is read: the catalog alone decides. A request takes the oldest cycles of its chain.
    """
    cycles = catalog.select(F.col("chain_v").alias("version"), "cycle_id").where(F.length("cycle_id") > 0)
    return sequence.oldest_n(cycles, requests, "version", "cycle_id", "chain_n")


def point_in_time_plan(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """Target times to the cycles to replay: all up to the newest one at or before the target.

    `targets` has target_id, chain_v and target_at (a timestamp); catalog stamps without
    offset belong to the default zone.
    """
    stamped = valid_catalog(catalog, with_stamp=True).select(
        "chain_v", "cycle_id", instant(F.col("cycle_timestamp")).alias("cycle_at")
    ).where("cycle_at is not null")
    picked = latest_before(stamped, targets, "cycle_at", "cycle_id", "target_at", ["chain_v"])
    wanted = picked.where("target_cycle is not null")
    return sequence.replay_prefix(stamped, wanted, "chain_v", "cycle_id", "target_cycle").select(
        "target_id", "chain_v", "target_cycle", "cycle_id"
    )


def opened_packages(plan: DataFrame, artifacts: DataFrame, ring: DataFrame) -> DataFrame:
    """Decrypted chunk rows of the planned cycles; a chunk that fails its tag has NULL content."""
    cycles = plan.select(F.col("version").alias("chain_v"), "cycle_id").distinct()
    needed = artifacts.join(cycles, ["chain_v", "cycle_id"], "left_semi")
    return crypto.decrypted(needed, ring, "artifact", crypto.chunk_identity(*IDENTITY))


def file_verdicts(opened: DataFrame, expected: DataFrame) -> DataFrame:
    """Per sealed file: its chunks, those that are lost, failed or differ, and a status.

    `expected` has one row per file as it was sealed (chain_v, cycle_id, rel_path, n_chunks), so a lost chunk, file
    or cycle is found by what should be there: status ok, missing, incomplete, altered, or unlisted for a file that
    was never sealed. Chunks are checked one by one, so a file of any size is verified without being assembled.
    """
    failed = F.col("content").isNull()
    differs = ~failed & ~F.sha2("content", 256).eqNullSafe(F.col("plain_sha256"))
    # A chunk that was written twice counts once.
    chunks = opened.groupBy(*IDENTITY).agg(
        F.bool_or(failed).alias("rejected"), F.bool_or(differs).alias("altered"),
        F.max(F.length("content")).alias("bytes"), F.max(F.length("artifact")).alias("stored"),
    )
    found = chunks.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n_found"), F.max("chunk_no").alias("last_chunk"),
        F.count_if("rejected").alias("rejected_chunks"), F.count_if("altered").alias("altered_chunks"),
        F.sum("bytes").alias("file_bytes"), F.sum("stored").alias("stored_bytes"),
    )
    sealed = expected.groupBy(*FILE).agg(F.max("n_chunks").alias("n_expected"))
    counts = ["n_found", "rejected_chunks", "altered_chunks"]
    joined = sealed.join(found, FILE, "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    status = (
        F.when(F.col("n_expected").isNull(), "unlisted").when(F.col("n_found") == 0, "missing")
        .when((F.col("rejected_chunks") > 0) | (F.col("altered_chunks") > 0), "altered")
        .when((F.col("n_found") != F.col("n_expected")) | (F.col("last_chunk") != F.col("n_expected") - 1), "incomplete")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("last_chunk")


def package_verdicts(opened: DataFrame, expected: DataFrame) -> DataFrame:
    """Per cycle: chunks found, failed and differing, files that are not whole, unsafe paths, and the verdict."""
    unsafe = text.unsafe_path(F.col("rel_path"))
    return file_verdicts(opened, expected).groupBy("chain_v", "cycle_id").agg(
        F.sum("n_found").alias("n_chunks"),
        F.sum("rejected_chunks").alias("rejected_chunks"),
        F.sum("altered_chunks").alias("altered_chunks"),
        F.count_if(F.col("status") != "ok").alias("failed_files"),
        F.bool_or(unsafe).alias("has_unsafe_path"),
        F.sum("file_bytes").alias("package_bytes"),
        F.sum("stored_bytes").alias("encrypted_bytes"),
    ).withColumn("ok", (F.col("failed_files") == 0) & ~F.col("has_unsafe_path"))


def deliverable(plan: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Planned cycles with `prefix_ok`: nothing after a failed or absent cycle is delivered."""
    judged = plan.join(
        verdicts.select(F.col("chain_v").alias("version"), "cycle_id", "ok", "package_bytes", "encrypted_bytes"),
        ["version", "cycle_id"], "left",
    ).withColumn("ok", F.coalesce("ok", F.lit(False)))
    return sequence.prefix_ok(judged, ["request_id"], ["replay_order"], "ok")


def restore_pass(
    plan: DataFrame, artifacts: DataFrame, ring: DataFrame, staging: str, telemetry: str, expected: DataFrame
) -> DataFrame:
    """Stage the deliverable cycles below `staging`, append telemetry, return the judged plan.

    Cycles are decrypted in parallel; the replay order decides only what is delivered. `expected`
    has the files as sealed; a cycle that is not whole is not delivered, nor what follows it. Staging
    replaces the partitions of the delivered cycles and leaves all others.
    """
    opened = opened_packages(plan, artifacts, ring)
    planned = plan.select(F.col("version").alias("chain_v"), "cycle_id")
    due = expected.join(planned, ["chain_v", "cycle_id"], "left_semi")
    judged = deliverable(plan, package_verdicts(opened, due))
    delivered = judged.where("prefix_ok").select(F.col("version").alias("chain_v"), "cycle_id").distinct()
    chunks = opened.join(delivered, ["chain_v", "cycle_id"], "left_semi").select(*IDENTITY, "content")
    replace_partitions(chunks, staging, ["chain_v", "cycle_id"])
    rows = judged.where("prefix_ok").select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit("restore").alias("workflow_type"), F.col("version").alias("chain_v"), "cycle_id",
        F.col("package_bytes").alias("raw_size_bytes"), F.col("encrypted_bytes").alias("encrypted_size_bytes"),
        *[F.lit(None).cast("double").alias(c) for c in (
            "duration_aes256_sec", "duration_cloud_transfer_sec", "duration_vm1_transfer_sec", "total_workflow_sec"
        )],
    )
    append_csv(rows, telemetry)
    return judged


def integrity_report(artifacts: DataFrame, verdicts: DataFrame, catalog: DataFrame, done: DataFrame) -> DataFrame:
    """Per cycle: presence of artifact, catalog row and done marker, chunk verdicts, and agreement of the two.

    A cycle passes when all three are there, the algorithm and the counts and sizes of the
    catalog hold for the stored bytes, and every chunk opens to its recorded digest.
    """
    present = integrity.reconciled(artifacts, catalog, done)
    listed = catalog.select(
        "chain_v", "cycle_id", "alg", F.col("n_chunks").alias("listed_chunks"), F.col("package_bytes").alias("listed_bytes")
    )
    joined = present.join(listed, ["chain_v", "cycle_id"], "left").join(verdicts, ["chain_v", "cycle_id"], "left")
    agrees = (
        (F.col("alg") == crypto.ALGORITHM) & (F.col("listed_chunks") == F.col("n_chunks"))
        & (F.col("listed_bytes") == F.col("package_bytes"))
    )
    return joined.withColumn("passed", F.coalesce(F.col("consistent") & agrees & F.col("ok"), F.lit(False)))
