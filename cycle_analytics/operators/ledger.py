"""The append-only ledger of stages, and what is still to do.

Plain files have no transactions, so a retried append can repeat a row; every reader
goes through `stages`, which keeps the first stamp per (chain, cycle, stage, target).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.operators.integrity import flagged

KEY = ["chain_v", "cycle_id"]
DONE = "done"
UPLOADED = "uploaded"


def stages(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*KEY, "stage", "target").agg(
        F.min("at").alias("at"), F.max("seconds").alias("seconds"), F.bool_and("reused").alias("reused")
    )


def finished(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("stage") == DONE).select(*KEY).distinct()


def pending(cycles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cycles without a done marker."""
    return cycles.join(finished(ledger), KEY, "left_anti")


def complete_artifacts(artifacts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Artifacts whose metadata document exists too."""
    return artifacts.join(metadata.select(*KEY).distinct(), KEY, "left_semi")


def upload_backlog(artifacts: DataFrame, metadata: DataFrame, ledger: DataFrame, targets: list[str]) -> DataFrame:
    """(cycle, target) pairs that still have to be sent. No targets, no backlog.

    Everything known of a cycle is brought together by one aggregation: presence flags, and
    per configured target whether it was sent.
    """
    if not targets:
        return artifacts.select(*KEY, F.lit("").alias("target")).limit(0)
    uploads = ledger.where((F.col("stage") == UPLOADED) & F.col("target").isin(targets))
    facts = [(artifacts, "artifact", None), (metadata, "metadata", None), (uploads, "sent", "target")]
    rows = reduce(
        DataFrame.unionByName,
        [df.select(*KEY, F.lit(fact).alias("_fact"), (F.col(t) if t else F.lit(None).cast("string")).alias("_target")) for df, fact, t in facts],
    )
    missing = [
        F.when(~F.coalesce(F.bool_or((F.col("_fact") == "sent") & (F.col("_target") == t)), F.lit(False)), F.lit(t)) for t in targets
    ]
    known = rows.groupBy(*KEY).agg(
        F.bool_or(F.col("_fact") == "artifact").alias("_stored"), F.bool_or(F.col("_fact") == "metadata").alias("_listed"),
        F.array(*missing).alias("_missing"),
    )
    return known.where("_stored and _listed").select(*KEY, F.explode("_missing").alias("target")).where("target is not null")


def purge_eligible(ledger: DataFrame, artifacts: DataFrame, metadata: DataFrame, ready: DataFrame) -> DataFrame:
    """Inputs that may be removed: done, stored completely and still verifying."""
    named = {
        "_done": ledger.where(F.col("stage") == DONE), "_stored": artifacts, "_listed": metadata, "_ready": ready.where("ready"),
    }
    return flagged(named, KEY).where("_done and _stored and _listed and _ready").select(*KEY)


def stage_seconds(ledger: DataFrame) -> DataFrame:
    """Upload seconds summed over the targets of each cycle, NULL where those of a target are unknown."""
    known = F.count("seconds") == F.count(F.lit(1))
    return stages(ledger).where(F.col("stage") == UPLOADED).groupBy(*KEY).agg(
        F.when(known, F.sum("seconds")).alias("upload_seconds"), F.count(F.lit(1)).alias("targets")
    )


def valid_catalog(catalog: DataFrame, with_stamp: bool = False) -> DataFrame:
    """Catalog rows with an id, and with a stamp where one is needed."""
    kept = catalog.where(F.length("cycle_id") > 0)
    return kept.where(F.length("cycle_timestamp") > 0) if with_stamp else kept
