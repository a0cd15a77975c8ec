"""Cycle packages on storage: files, manifests, checksum lists, catalogs, requests and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics import schemas
from cycle_analytics.functions.clock import DEFAULT_ZONE, instant
from cycle_analytics.functions.documents import COMPONENTS, manifest_summary
from cycle_analytics.operators.integrity import CHECKSUM_FILE, MANIFEST_FILE, checksum_lines, content_digest
from cycle_analytics.operators.requests import unclaimed
from cycle_analytics.session import tasks_for, written
from cycle_analytics.sources import listing

_FILE = ["chain_v", "cycle_id", "rel_path"]
_PLACE = r"/([^/]+)/([^/]+)/(.+)$"


def placed_files(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """chain, cycle and relative path from a path below `root`.

    Folders may be plain or named key=value; dot folders do not count. The root ends where its text stands first,
    so folders below may repeat it.
    """
    anchor = "/" + root.rstrip("/").split(":")[-1].strip("/") + "/"
    plain = F.concat(F.lit("/"), F.regexp_replace(F.col(path), "^[A-Za-z][A-Za-z0-9+.-]*:/+|^/+", ""))
    place = F.locate(anchor, plain)
    below = F.when(place > 0, F.substring(plain, place + len(anchor) - 1, F.length(plain)))
    keyed = df.withColumns(
        {
            "chain_v": F.regexp_replace(F.regexp_extract(below, _PLACE, 1), "^chain_v=", ""),
            "cycle_id": F.regexp_replace(F.regexp_extract(below, _PLACE, 2), "^cycle_id=", ""),
            "rel_path": F.regexp_extract(below, _PLACE, 3),
        }
    )
    return keyed.where((F.col("chain_v") != "") & ~F.col("chain_v").startswith(".") & ~F.col("cycle_id").startswith("."))


def files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """All files below <root>/<chain>/<cycle>/, with digest; without content only sizes are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    placed = placed_files(df, root)
    columns = ["chain_v", "cycle_id", "rel_path", F.col("length").alias("bytes")]
    if with_content:
        columns += ["content", content_digest(F.col("content")).alias("actual_sha256")]
    return placed.select(*columns)


def digested_files(spark: SparkSession, root: str) -> DataFrame:
    """The same files without content: listed by tasks, and read by them block by block. A file of any size will do."""
    found = written(listing.listed(spark, root), "package-listing")
    return listing.file_digests(placed_files(found, root)).select(*_FILE, "bytes", "actual_sha256")


def cycles(spark: SparkSession, root: str) -> DataFrame:
    """Chains and cycles present, with file counts and bytes; file contents are not read."""
    return placed_files(listing.listed(spark, root), root).groupBy("chain_v", "cycle_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes")
    )


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifest documents with a summary; broken documents give NULL, not an error."""
    df = (
        spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", MANIFEST_FILE).json(root)
    )
    placed = placed_files(df.withColumn("_path", F.col("_metadata.file_path")), root, "_path")
    summary = manifest_summary(
        {name: F.col(name) for name in ("chain_version", "pg_last_lsn", "mongo_last_ts")},
        {name: F.col(name).isNotNull() for name in COMPONENTS},
        F.col("pfc.scanned_sizes"),
        F.col("files.scanned_sizes"),
    )
    return placed.select("chain_v", "cycle_id", "cycle_timestamp", summary.alias("manifest_summary"))


def manifest_stamps(manifest_df: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Instant of each cycle; a missing stamp is reported in `stamp_error`."""
    return manifest_df.withColumn("cycle_at", instant(F.col("cycle_timestamp"), zone)).withColumn(
        "stamp_error", F.when(F.col("cycle_at").isNull(), "missing cycle_timestamp")
    )


def checksum_lists(spark: SparkSession, root: str) -> DataFrame:
    """Expected digests of all packages; only the lists are read, each by one task."""
    lists = listing.listed(spark, root).where(F.col("path").endswith(f"/{CHECKSUM_FILE}"))
    dealt = placed_files(lists, root).repartition(tasks_for(lists, listing.TASK_BYTES), "path")
    return checksum_lines(listing.file_lines(dealt.select("path", "chain_v", "cycle_id")).drop("path")).select(*_FILE, "expected_sha256")


def catalog_documents(
    spark: SparkSession, root: str, chain: str | None = None, pattern: str = "*.meta.json", multi_line: bool = True
) -> DataFrame:
    """Metadata documents of a local or object-store root; unparseable ones are skipped."""
    path = f"{root.rstrip('/')}/{chain}" if chain else root
    return (
        spark.read.schema(schemas.CATALOG).option("multiLine", multi_line).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).json(path).where(F.length("cycle_id") > 0)
    )


def _named(found: DataFrame, ending: str) -> DataFrame:
    """request_id and path of the files of a listing that end so."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.where(name.endswith(ending)).select(F.substring(name, F.lit(1), F.length(name) - len(ending)).alias("request_id"), "path", "bytes")


def _bodies(found: DataFrame) -> DataFrame:
    return listing.file_texts(found).select("request_id", F.col("value").alias("body"))


def request_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Request files as (request_id, body), for batch use. They are listed and read by tasks."""
    return _bodies(written(_named(listing.own_files(spark, folder), ".json"), "request-listing"))


def done_markers(spark: SparkSession, folder: str) -> DataFrame:
    return _named(listing.own_files(spark, folder), ".done").select("request_id")


def open_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request files without a done marker, as (request_id, body). The folder is listed once, and only open ones are read."""
    found = written(listing.own_files(spark, folder), "request-listing")
    return _bodies(written(unclaimed(_named(found, ".json"), _named(found, ".done")), "open-requests"))


def service_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as (at, level, message, kind, chain_v, cycle_id)."""
    return log_lines(spark.read.text(path), "value")


def log_lines(df: DataFrame, text: str) -> DataFrame:
    pattern = r"^\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)[+-]\d{4}\]\s+(?:<(\w+)>\s*)?(.*)$"
    message = F.regexp_extract(text, pattern, 3)
    cycle = r"(processing|done) cycle ([^/\s]+)/(\S+)"
    return df.select(
        F.regexp_extract(text, pattern, 1).try_cast("timestamp_ntz").alias("at"),
        F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("level"),
        message.alias("message"),
        F.nullif(F.regexp_extract(message, cycle, 1), F.lit("")).alias("kind"),
        F.nullif(F.regexp_extract(message, cycle, 2), F.lit("")).alias("chain_v"),
        F.nullif(F.regexp_extract(message, cycle, 3), F.lit("")).alias("cycle_id"),
    )


def cycle_progress(log: DataFrame) -> DataFrame:
    """Start, end and seconds per cycle from its processing and done lines."""
    spans = log.where(F.col("kind").isNotNull()).groupBy("chain_v", "cycle_id").agg(
        F.min(F.when(F.col("kind") == "processing", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("kind") == "done", F.col("at"))).alias("ended_at"),
    )
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("ended_at", "started_at")]
    return spans.withColumn("seconds", (micros[0] - micros[1]) / 1e6)
