"""The restore-request listener: each request once, bad ones with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.functions.documents import parsed_requests
from cycle_analytics.operators.requests import unclaimed
from cycle_analytics.streaming.passes import start
from cycle_analytics.streaming.store import Store

TABLES = {
    "requests": "request_id string, error_reason string, version string, chain_n bigint, source string, "
    "send boolean, dest_root string",
}


def new_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES).create()


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving request files as (request_id, body)."""
    stream = (
        spark.readStream.schema("value string").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    )
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return stream.select(name.alias("request_id"), F.col("value").alias("body"))


def listen(stream: DataFrame, store: Store, default_dest: str, once: bool = False, cloud_alias: bool = False):
    """Validate arriving requests; one that was already taken is left out."""

    def each(arrived: DataFrame, batch_id: int) -> None:
        fresh = unclaimed(arrived.dropDuplicates(["request_id"]), store.before("requests", batch_id))
        checked = parsed_requests(fresh, "body", default_dest, cloud_alias)
        store.write(checked.drop("body"), "requests", batch_id)

    return start(stream, each, f"{store.root}/checkpoint", once).start()


def accepted(store: Store) -> DataFrame:
    return store.read("requests").where("error_reason is null").drop("error_reason", "batch")


def refused(store: Store) -> DataFrame:
    return store.read("requests").where("error_reason is not null").select("request_id", "error_reason")
