"""The backup pass, as one foreachBatch job: over arriving package files, or over polls of a folder.

Each micro-batch adds the arrived files, looks again at every package that is not stored yet, and moves ready ones
through the stages stored -> uploaded (per target) -> done. A stage depends only on ledger rows, so a pass that
stopped half-way is taken up by the next one.

What is not ready is carried from batch to batch in the small tables `open_files` and `open_lists`; contents lie in
partitions by (batch, chain, cycle), and a pass reads those of the packages it seals or sends, not the history.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cycle_analytics import schemas
from cycle_analytics.functions import crypto
from cycle_analytics.functions.documents import COMPONENTS, manifest_summary
from cycle_analytics.operators import chunks, integrity, ledger
from cycle_analytics.session import among
from cycle_analytics.sources import listing
from cycle_analytics.sources.packages import placed_files
from cycle_analytics.streaming.store import Store

KEY = ["chain_v", "cycle_id"]
FILE = [*KEY, "rel_path"]
IDENTITY = [*FILE, "chunk_no"]
CHUNK_BYTES = 4 * 1024 * 1024
POLL_INTERVAL = "15 seconds"
STORED = "stored"
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
FOUND = "chain_v string, cycle_id string, rel_path string, bytes bigint, actual_sha256 string"

TABLES = {
    "listing": listing.LISTING,
    "taken": listing.LISTING,
    "content": f"{FOUND}, chunk_no int, chunk binary",
    "inventory": FOUND,
    "lists": "chain_v string, cycle_id string, rel_path string, expected_sha256 string",
    "open_files": f"{FOUND}, content_batch int",
    "open_lists": "chain_v string, cycle_id string, rel_path string, expected_sha256 string, list_batch int",
    "ready": f"{FOUND}, content_batch int",
    "artifacts": "chain_v string, cycle_id string, rel_path string, chunk_no int, plain_bytes int, "
    "plain_sha256 string, key_id string, artifact binary",
    "sealed": "chain_v string, cycle_id string, rel_path string, n_chunks bigint",
    "catalog": "alg string, chain_v string, cycle_id string, created_at timestamp, n_files bigint, n_chunks bigint, "
    f"package_bytes bigint, encrypted_bytes bigint, cycle_timestamp string, manifest_summary {schemas.MANIFEST_SUMMARY}",
    "ledger": schemas.LEDGER,
    "telemetry": schemas.WORKFLOW,
}
PARTS = {"content": KEY, "artifacts": KEY}
SENT = ("artifacts", "sealed", "catalog")
TABLE_COLUMNS = {
    "artifacts": [*IDENTITY, "plain_bytes", "plain_sha256", "key_id", "artifact"],
    "catalog": [
        "alg", *KEY, "created_at", "n_files", "n_chunks", "package_bytes", "encrypted_bytes", "cycle_timestamp", "manifest_summary",
    ],
}


def new_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES, PARTS).create()


def list_lines(files: DataFrame) -> DataFrame:
    """Lines of the checksum lists among arrived files."""
    lists = files.where(F.col("rel_path") == integrity.CHECKSUM_FILE)
    return lists.select(*KEY, F.explode(F.split(F.col("content").cast("string"), "\n")).alias("value"))


def keep_lists(store: Store, lines: DataFrame, batch_id: int) -> None:
    listed = integrity.checksum_lines(lines).select(*FILE, "expected_sha256")
    store.write(listed, "lists", batch_id)


def add_arrivals(store: Store, files: DataFrame, lines: DataFrame, batch_id: int, chunk_bytes: int) -> None:
    """Keep contents as chunks; the arrived files are read once, all else comes from the written rows."""
    hashed = files.select(
        *FILE, "content", F.length("content").cast("bigint").alias("bytes"),
        integrity.content_digest(F.col("content")).alias("actual_sha256"),
    )
    store.write(chunks.chunked(hashed, "content", chunk_bytes), "content", batch_id)
    first = store.only("content", batch_id).where("chunk_no = 0")
    store.write(first.select(*FILE, "bytes", "actual_sha256"), "inventory", batch_id)
    keep_lists(store, lines, batch_id)


def add_listed(store: Store, arrivals: DataFrame, batch_id: int, chunk_bytes: int) -> None:
    """The same for files of a listing (path, bytes, FILE), which are read by range and never held whole.

    A file that was changed while it was read is left out: its chunks do not add up to what was hashed. It has a
    new stamp, so the next poll brings it again.
    """
    hashed = listing.file_digests(arrivals).where("read_bytes = bytes")
    hashed_rows = store.staged(hashed, "digests", batch_id)
    parts = listing.file_parts(hashed_rows, chunk_bytes, near=FILE)
    store.write(
        parts.select(*FILE, "bytes", "actual_sha256", F.col("chunk_no").cast("int").alias("chunk_no"), "chunk"), "content", batch_id
    )
    kept = store.only("content", batch_id).groupBy(*FILE, "bytes", "actual_sha256").agg(F.sum(F.length("chunk")).alias("_held"))
    store.write(kept.where("_held = bytes").select(*FILE, "bytes", "actual_sha256"), "inventory", batch_id)
    lists = arrivals.where(F.col("rel_path") == integrity.CHECKSUM_FILE)
    keep_lists(store, listing.file_lines(lists.select("path", *KEY)).select(*KEY, "value"), batch_id)


def carried(store: Store, name: str, batch_id: int) -> DataFrame:
    """What the last batch before this one left open."""
    last = store.newest(name, batch_id)
    return store.only(name, last) if last is not None else store.only(name, batch_id).limit(0)


def open_packages(store: Store, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Newest version of every file of packages that are not stored, and their newest checksum lists, each as a whole."""
    stored = store.before("catalog", batch_id).select(*KEY)
    arrived = store.only("inventory", batch_id).withColumn("content_batch", F.lit(batch_id))
    rows = carried(store, "open_files", batch_id).unionByName(arrived).join(stored, KEY, "left_anti")
    newest = F.max_by(F.struct("bytes", "actual_sha256", "content_batch"), "content_batch").alias("_v")
    files = rows.groupBy(*FILE).agg(newest).select(*FILE, "_v.*")
    lines = carried(store, "open_lists", batch_id).unionByName(
        store.only("lists", batch_id).withColumn("list_batch", F.lit(batch_id))
    )
    whole = files.where(F.col("rel_path") == integrity.CHECKSUM_FILE).select(*KEY, F.col("content_batch").alias("list_batch"))
    return files, lines.join(whole, [*KEY, "list_batch"], "left_semi")


def settle(store: Store, batch_id: int) -> None:
    """Divide the open packages into ready ones and those that are carried on."""
    files, lists = open_packages(store, batch_id)
    files = store.staged(files, "known", batch_id)
    ready = integrity.readiness(files, lists).where("ready").select(*KEY)
    store.write(files.join(ready, KEY, "left_semi"), "ready", batch_id)
    done = store.only("ready", batch_id).select(*KEY).distinct()
    store.write(files.join(done, KEY, "left_anti"), "open_files", batch_id)
    store.write(lists.join(done, KEY, "left_anti"), "open_lists", batch_id)


def manifests(content: DataFrame) -> DataFrame:
    """Stamp and summary of each package's manifest, from its chunk rows; broken documents give NULL."""
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", F.col("chunk").cast("string").alias("text"))))
    document = F.array_join(F.transform(pieces, lambda p: p["text"]), "")
    texts = content.where(F.col("rel_path") == integrity.MANIFEST_FILE).groupBy(*KEY).agg(document.alias("_text"))
    read = texts.withColumn("_m", F.from_json("_text", schemas.MANIFEST))
    summary = manifest_summary(
        {name: F.col(f"_m.{name}") for name in ("chain_version", "pg_last_lsn", "mongo_last_ts")},
        {name: F.col(f"_m.{name}").isNotNull() for name in COMPONENTS},
        F.col("_m.pfc.scanned_sizes"), F.col("_m.files.scanned_sizes"),
    )
    return read.select(*KEY, F.col("_m.cycle_timestamp").alias("cycle_timestamp"), summary.alias("manifest_summary"))


def seal(store: Store, ring: DataFrame, batch_id: int) -> None:
    """Encrypt the chunks of ready packages and catalogue the bytes as written."""
    due = store.only("ready", batch_id).select(*FILE, F.col("content_batch").alias("batch"))
    plain = among(store.read("content"), due, [*FILE, "batch"])
    hashed = plain.withColumns({"plain_bytes": F.length("chunk"), "plain_sha256": F.sha2("chunk", 256)})
    sealed = crypto.encrypted(hashed, ring, "chunk", crypto.chunk_identity(*IDENTITY))
    store.write(sealed.select(*TABLE_COLUMNS["artifacts"]), "artifacts", batch_id)
    written = store.only("artifacts", batch_id)
    store.write(written.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_chunks")), "sealed", batch_id)
    totals = written.groupBy(*KEY).agg(
        F.count_distinct("rel_path").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"),
        F.sum("plain_bytes").alias("package_bytes"), F.sum(F.length("artifact")).cast("bigint").alias("encrypted_bytes"),
    )
    told = totals.join(manifests(plain), KEY, "left").withColumns(
        {"alg": F.lit(crypto.ALGORITHM), "created_at": F.current_timestamp()}
    )
    store.write(told.select(*TABLE_COLUMNS["catalog"]), "catalog", batch_id)


def replicate(store: Store, target: str, uri: str, batch_id: int) -> bool:
    """Send the target's backlog: artifacts of a cycle, then its sealed files, then its catalog row.

    A cycle's artifacts are a partition of the target, so sending it again replaces them, and it counts as there once
    its catalog row is (`target_table`). A failing target is tried again later.
    """
    catalog = store.read("catalog").where(F.col("batch") <= batch_id)
    waiting = ledger.upload_backlog(catalog, catalog, store.before("ledger", batch_id), [target]).select(*KEY)
    # With its batch a cycle names the partitions to read.
    due = store.staged(catalog.join(waiting, KEY, "left_semi").select(*KEY, "batch"), f"due-{target}", batch_id)
    root = uri.rstrip("/")
    try:
        for name in SENT:
            rows = among(store.read(name), due, [*KEY, "batch"]).drop("batch")
            if name in PARTS:
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS[name]).parquet(f"{root}/{name}")
            else:
                rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/{name}/batch={batch_id}")
        return True
    except (PySparkException, Py4JJavaError, OSError):  # a failed write in the JVM is the second kind
        return False


def target_table(spark: SparkSession, uri: str, name: str) -> DataFrame:
    """What a target holds of completely sent cycles, each row once however often it was sent."""
    root = uri.rstrip("/")
    catalog = spark.read.schema(TABLES["catalog"]).parquet(f"{root}/catalog").dropDuplicates(KEY)
    if name == "catalog":
        return catalog
    rows = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}").join(catalog.select(*KEY), KEY, "left_semi")
    return rows if name in PARTS else rows.dropDuplicates(FILE)


def ledger_rows(store: Store, sent: list[str], targets: list[str], batch_id: int) -> DataFrame:
    """New stage rows: stored, uploaded for each target that took its backlog, done when all have."""
    before = store.before("ledger", batch_id)
    now = F.current_timestamp().cast("timestamp_ntz")

    def stamped(df: DataFrame, stage: str, target: str | None, reused) -> DataFrame:
        return df.select(
            *KEY, F.lit(stage).alias("stage"), F.lit(target).cast("string").alias("target"), now.alias("at"),
            F.lit(None).cast("double").alias("seconds"), reused.alias("reused"),
        )

    catalog = store.upto("catalog", batch_id).select(*KEY)
    rows = stamped(store.only("catalog", batch_id).select(*KEY), STORED, None, F.lit(False))
    uploaded = before.where(F.col("stage") == ledger.UPLOADED).select(*KEY, "target").distinct()
    for target in sent:
        waiting = ledger.upload_backlog(catalog, catalog, before, [target]).select(*KEY)
        fresh = stamped(waiting, ledger.UPLOADED, target, F.lit(False))
        rows = rows.unionByName(fresh)
        uploaded = uploaded.unionByName(fresh.select(*KEY, "target"))
    complete = catalog
    if targets:
        counts = uploaded.where(F.col("target").isin(targets)).distinct().groupBy(*KEY).agg(F.count("target").alias("n"))
        complete = catalog.join(counts.where(F.col("n") == len(set(targets))), KEY, "left_semi")
    finished = ledger.pending(complete, before)
    earlier = store.before("catalog", batch_id).select(*KEY).withColumn("_early", F.lit(True))
    marked = finished.join(earlier, KEY, "left").withColumn("_early", F.coalesce("_early", F.lit(False)))
    return rows.unionByName(stamped(marked, ledger.DONE, None, F.col("_early")))


def advance(store: Store, batch_id: int, ring: DataFrame, targets: dict[str, str]) -> None:
    """Move packages on after the arrivals are kept. The ledger is written last and only once."""
    settle(store, batch_id)
    seal(store, ring, batch_id)
    sent = [name for name, uri in targets.items() if replicate(store, name, uri, batch_id)]
    done = store.only("catalog", batch_id).select(
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit("backup").alias("workflow_type"), *KEY, F.col("package_bytes").alias("raw_size_bytes"),
        F.col("encrypted_bytes").alias("encrypted_size_bytes"),
        *[F.lit(None).cast("double").alias(c) for c in (
            "duration_aes256_sec", "duration_cloud_transfer_sec", "duration_vm1_transfer_sec", "total_workflow_sec"
        )],
    )
    store.write(done, "telemetry", batch_id)
    store.write(ledger_rows(store, sent, list(targets), batch_id), "ledger", batch_id)


def run_pass(
    store: Store, files: DataFrame, batch_id: int, ring: DataFrame, targets: dict[str, str],
    lines: DataFrame | None = None, chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """One pass over arrived files (FILE, content). A repeated pass changes nothing."""
    add_arrivals(store, files, list_lines(files) if lines is None else lines, batch_id, chunk_bytes)
    advance(store, batch_id, ring, targets)


def run_poll(
    store: Store, found: DataFrame, root: str, batch_id: int, ring: DataFrame, targets: dict[str, str],
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """One pass over a listing of `root`. Files whose path, stamp and size were taken before are not read again."""
    store.write(found, "listing", batch_id)
    taken = store.before("taken", batch_id).distinct()
    store.write(store.only("listing", batch_id).join(taken, ["path", "modified", "bytes"], "left_anti"), "taken", batch_id)
    add_listed(store, placed_files(store.only("taken", batch_id), root), batch_id, chunk_bytes)
    advance(store, batch_id, ring, targets)


def plaintext_to_retire(store: Store) -> DataFrame:
    """Partitions of plain contents that nothing needs any more: their cycle is done, or a newer version came."""
    done = ledger.finished(store.read("ledger"))
    held = store.read("content").select("batch", *KEY).distinct()
    newest = store.newest("open_files", 1 << 31)
    wanted = store.only("open_files", newest).select(F.col("content_batch").alias("batch"), *KEY).distinct() if newest is not None else None
    finished = held.join(done, KEY, "left_semi")
    if wanted is None:
        return finished
    open_cycles = wanted.select(*KEY).distinct()
    outdated = held.join(open_cycles, KEY, "left_semi").join(wanted, ["batch", *KEY], "left_anti")
    return finished.unionByName(outdated)


def incoming_stream(spark: SparkSession, root: str, chain: str | None = None) -> DataFrame:
    """Arriving package files; with `chain` only that chain's folder is listed."""
    path = f"{root.rstrip('/')}/{chain}" if chain else root
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(path)
    return placed_files(stream, root).select(*KEY, "rel_path", "content")


def start(stream: DataFrame, run, checkpoint: str, once: bool) -> DataStreamWriter:
    """A foreachBatch query that polls, or takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)


def backup_stream(
    stream: DataFrame, store: Store, ring: DataFrame, targets: dict[str, str], once: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
):
    """Start the backup passes over a stream of package files."""

    def each(files: DataFrame, batch_id: int) -> None:
        run_pass(store, files, batch_id, ring, targets, chunk_bytes=chunk_bytes)

    return start(stream, each, f"{store.root}/checkpoint", once).start()


def polled_backup(
    spark: SparkSession, root: str, store: Store, ring: DataFrame, targets: dict[str, str], once: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
):
    """Backup passes over polls of `root`: rewritten files are taken again, and every poll tries open uploads."""

    def each(found: DataFrame, batch_id: int) -> None:
        run_poll(store, found, root, batch_id, ring, targets, chunk_bytes)

    return start(listing.polled(spark, root), each, f"{store.root}/checkpoint", once).start()
