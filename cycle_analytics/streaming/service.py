"""The restore service: arriving requests to plans, restored files and outcomes, each request once.

Every micro-batch validates its requests, plans them over the catalog as it is then, restores from the replicas and
writes one outcome per request last. A batch that is repeated delivers the same files again and replaces its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.functions.documents import parsed_requests
from cycle_analytics.operators.requests import unclaimed
from cycle_analytics.plans.replicas import restored
from cycle_analytics.plans.restore import restore_plan
from cycle_analytics.streaming import listener
from cycle_analytics.streaming.passes import start
from cycle_analytics.streaming.store import Store

TABLES = {
    **listener.TABLES,
    "delivered": "path string, bytes bigint, sha256 string, dest_root string",
    "outcomes": "request_id string, state string, reason string, selected bigint, delivered bigint",
}
DONE, ERROR = "done", "error"


@dataclass(frozen=True)
class Holdings:
    """What there is to restore from: catalog rows, replicas by name, the files as sealed, and the key ring."""

    catalog: DataFrame
    replicas: dict[str, DataFrame]
    sealed: DataFrame
    ring: DataFrame


def new_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES).create()


def outcomes(requests: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per request: refused, without cycles, stopped before its last cycle, or done."""
    counts = judged.groupBy("request_id").agg(F.max("selected").alias("selected"), F.count_if("prefix_ok").alias("delivered"))
    met = requests.join(counts, "request_id", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))
    reason = (
        F.when(F.col("error_reason").isNotNull(), F.col("error_reason")).when(F.col("selected").isNull(), "no_cycles")
        .when(F.col("delivered") < F.col("selected"), "not_whole")
    )
    told = met.withColumn("reason", reason)
    return told.select("request_id", F.when(F.col("reason").isNull(), DONE).otherwise(ERROR).alias("state"), "reason", "selected", "delivered")


def serve_batch(store: Store, arrived: DataFrame, batch_id: int, held: Holdings, default_dest: str) -> None:
    fresh = unclaimed(arrived.dropDuplicates(["request_id"]), store.before("requests", batch_id))
    store.write(parsed_requests(fresh, "body", default_dest).drop("body"), "requests", batch_id)
    requests = store.only("requests", batch_id)
    plan = restore_plan(requests.where("error_reason IS NULL"), held.catalog)
    judged, delivered = restored(store.spark, plan, held.replicas, held.sealed, held.ring)
    store.write(delivered, "delivered", batch_id)
    store.write(outcomes(requests, judged), "outcomes", batch_id)


def serve(stream: DataFrame, store: Store, held: Holdings, default_dest: str, once: bool = False):
    """Answer a stream of (request_id, body)."""

    def each(arrived: DataFrame, batch_id: int) -> None:
        serve_batch(store, arrived, batch_id, held, default_dest)

    return start(stream, each, f"{store.root}/checkpoint", once).start()
