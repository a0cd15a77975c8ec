"""Queries that run whole passes over files: polled backups, request outcomes, scans by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.functions import crypto
from cycle_analytics.operators import integrity
from cycle_analytics.plans.integrity_queries import CHUNK_BYTES, DUMMY_KEY
from cycle_analytics.plans.registry import query
from cycle_analytics.plans.restore import point_in_time_plan
from cycle_analytics.session import make_folder, new_folder, written
from cycle_analytics.sources import charts, listing, packages, sinks
from cycle_analytics.sources.packages import placed_files
from cycle_analytics.sources.tables import table
from cycle_analytics.streaming import passes, states

KEY = passes.KEY


def put_files(chunks: DataFrame, root: str) -> DataFrame:
    """Write the files and return what was written (path, bytes, sha256)."""
    make_folder(chunks.sparkSession, root)
    return written(sinks.assembled_files(chunks, root), "put-files")


def package_folder():
    """Folder of a document's package. Cycles are numbered in two digits, so that their names sort as their numbers."""
    number = F.lpad(F.regexp_extract("source", r"(\d+)$", 1), 2, "0")
    return F.concat(F.lit("chain-"), "lang", F.lit("/cycle-"), number, F.lit("/"))


def package_chunks(spark, root, altered) -> DataFrame:
    """Documents as packages, in chunk rows (path, chunk_no, chunk, lang): files, checksum list and manifest.

    Files for which `altered` holds differ from the list.
    """
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", F.col("text").cast("binary").alias("content"))
    number = F.regexp_extract("source", r"(\d+)$", 1)
    folder = package_folder()
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(
        F.concat(folder, name).alias("path"), F.lit(0).cast("bigint").alias("chunk_no"),
        F.when(altered, F.lit("altered").cast("binary")).otherwise(F.col("content")).alias("chunk"), "lang",
    )
    # A list is written line by line, in order of the document: no line ever meets another.
    lines = docs.select(
        F.concat(folder, F.lit(integrity.CHECKSUM_FILE)).alias("path"), F.col("doc_id").alias("chunk_no"),
        F.concat(F.sha2("content", 256), F.lit("  "), name, F.lit("\n")).cast("binary").alias("chunk"), "lang",
    )
    stamp = F.concat(F.lit("2026-06-"), F.lpad(number.cast("int") + 1, 2, "0"), F.lit("T08:00:00"))
    document = F.to_json(
        F.struct(stamp.alias("cycle_timestamp"), F.col("lang").alias("chain_version"), F.lit("{}").alias("mongo"))
    )
    manifests = docs.select("lang", "source").distinct().select(
        F.concat(folder, F.lit(integrity.MANIFEST_FILE)).alias("path"), F.lit(0).cast("bigint").alias("chunk_no"),
        document.cast("binary").alias("chunk"), "lang",
    )
    return files.unionByName(lines).unionByName(manifests)


def polled_store(spark, polls: list[tuple[DataFrame | None, dict[str, str]]], base: str) -> passes.Store:
    """A store after some polls; each has the chunk rows of the files that come before it, and its targets."""
    incoming, store = f"{base}/incoming", passes.new_store(spark, f"{base}/store")
    ring = crypto.key_ring(spark, key=DUMMY_KEY)
    for chunks, targets in polls:
        if chunks is not None:
            put_files(chunks, incoming)
        passes.polled_backup(spark, incoming, store, ring, targets, once=True, chunk_bytes=CHUNK_BYTES).awaitTermination()
    return store


def four_polls(spark, root) -> passes.Store:
    """1: all chains but `fr` come, some files altered. 2: those files are rewritten. 3: chain `fr` comes, the second
    target fails. 4: nothing comes, the target is back.
    """
    base = new_folder(spark, "polled")
    good = {name: f"{base}/target-{name}" for name in ("general", "immutable")}
    # A folder below a file can never be made.
    put_files(spark.range(1).select(F.lit("d/wall").alias("path"), F.lit(0).alias("chunk_no"), F.lit(b"x").alias("chunk")), f"{base}/blocked")
    failing = {**good, "immutable": f"{base}/blocked/d/wall/immutable"}
    bad, fr = F.col("doc_id") % 97 == 0, F.col("lang") == "fr"
    as_meant = package_chunks(spark, root, F.lit(False))
    name = F.concat(package_folder(), F.col("doc_id").cast("string"), F.lit(".txt"))
    rewritten = as_meant.join(table(spark, root, "documents").where(bad).select(name.alias("path")), "path", "left_semi")
    return polled_store(spark, [
        (package_chunks(spark, root, bad).where(~fr), good), (rewritten.where(~fr), good), (as_meant.where(fr), failing), (None, good),
    ], base)


_CYCLE = "'cycle-' || lpad(regexp_extract(source, '[0-9]+$'), 2, '0') AS cycle_id"
_POLLS = "CASE WHEN lang = 'fr' THEN 3 WHEN bool_or(doc_id % 97 = 0) THEN 2 ELSE 1 END"


@query(
    f"""SELECT 'chain-' || lang AS chain_v, {_CYCLE}, count(*) + 2 AS n_files, lang AS manifest_chain,
          strftime(TIMESTAMP '2026-06-01 08:00:00' + to_days(CAST(regexp_extract(source, '[0-9]+$') AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS cycle_timestamp,
          {_POLLS} AS stored_poll, {_POLLS} AS general_poll, CASE WHEN lang = 'fr' THEN 4 ELSE {_POLLS} END AS immutable_poll,
          CASE WHEN lang = 'fr' THEN 4 ELSE {_POLLS} END AS done_poll, lang = 'fr' AS reused
        FROM documents GROUP BY lang, source"""
)
def stream_polled_backup(spark, root):
    """In which poll each package was stored, sent to each target and done."""
    store = four_polls(spark, root)
    poll = (F.col("batch") + 1).cast("int")

    def first(stage: str, target: str | None = None):
        hit = (F.col("stage") == stage) & (F.col("target") == target if target else F.lit(True))
        return F.min(F.when(hit, poll))

    stages = store.read("ledger").groupBy(*KEY).agg(
        first("stored").alias("stored_poll"), first("uploaded", "general").alias("general_poll"),
        first("uploaded", "immutable").alias("immutable_poll"), first("done").alias("done_poll"),
        F.bool_or(F.when(F.col("stage") == "done", F.col("reused"))).alias("reused"),
    )
    catalog = store.read("catalog").select(
        *KEY, "n_files", F.col("manifest_summary.chain_version").alias("manifest_chain"), "cycle_timestamp"
    )
    return catalog.join(stages, KEY)


@query(
    f"""WITH c AS (SELECT DISTINCT 'chain-' || lang AS chain_v, {_CYCLE}, CAST(regexp_extract(source, '[0-9]+$') AS INTEGER) AS n FROM documents),
       t AS (SELECT chain_v, unnest([0, 4, 9, 30]) AS up_to FROM (SELECT DISTINCT chain_v FROM c)),
       l AS (SELECT t.chain_v, up_to, max(n) AS last FROM t JOIN c ON c.chain_v = t.chain_v AND n <= up_to GROUP BY ALL)
       SELECT l.chain_v || '@' || up_to AS target_id, l.chain_v, k.cycle_id AS target_cycle, c.cycle_id
       FROM l JOIN c k ON k.chain_v = l.chain_v AND k.n = last JOIN c ON c.chain_v = l.chain_v AND c.n <= last"""
)
def point_in_time_from_backup(spark, root):
    """Target times to the cycles to replay, from the catalog that the backup pass wrote."""
    store = polled_store(spark, [(package_chunks(spark, root, F.lit(False)), {})], new_folder(spark, "polled"))
    catalog = store.read("catalog").select(*KEY, "cycle_timestamp")
    days = F.explode(F.array(*[F.lit(n) for n in (0, 4, 9, 30)]))
    targets = catalog.select("chain_v").distinct().select("chain_v", days.alias("n")).select(
        F.concat("chain_v", F.lit("@"), F.col("n").cast("string")).alias("target_id"), "chain_v",
        # The stamps of the manifests are of the default zone, seven hours ahead.
        F.timestamp_add("DAY", F.col("n"), F.lit("2026-06-01 01:00:00").cast("timestamp")).alias("target_at"),
    )
    return point_in_time_plan(catalog, targets)


@query(
    """WITH e AS (SELECT strftime(ts, '%Y%m%d%H') AS request_id, ts,
           CASE event_type WHEN 'click' THEN 'inprogress' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'pending' END AS state FROM events),
       o AS (SELECT request_id, min(ts) AS opened, min(ts) FILTER (state IN ('done', 'error')) AS ended,
           arg_min(state, (ts, state)) FILTER (state IN ('done', 'error')) AS outcome FROM e GROUP BY 1)
       SELECT request_id, CASE WHEN epoch_us(ended) - epoch_us(opened) < 1200000000 THEN outcome ELSE 'timeout' END AS outcome,
         CASE WHEN epoch_us(ended) - epoch_us(opened) < 1200000000 THEN (epoch_us(ended) - epoch_us(opened)) / 1000000.0::DOUBLE ELSE 1200.0 END AS waited_s FROM o"""
)
def stream_request_outcomes(spark, root):
    """Status events in four batches that know no order; the outcome of a request leaves once."""
    state = (
        F.when(F.col("event_type") == "click", "inprogress").when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "error", "error").otherwise("pending")
    )
    events = table(spark, root, "events").select(
        F.date_format("ts", "yyyyMMddHH").alias("request_id"), state.alias("state"), F.col("ts").cast("timestamp").alias("at"), "event_id"
    )
    folder, out, state_root = (new_folder(spark, f"outcomes-{part}") for part in ("in", "out", "state"))
    make_folder(spark, folder)
    stream = states.outcomes(
        spark.readStream.schema("request_id string, state string, at timestamp").parquet(folder), timeout_seconds=1200, lateness="4000 days"
    )

    def arrive(rows: DataFrame) -> None:
        rows.select("request_id", "state", "at").write.mode("append").parquet(folder)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state_root)
        writer.trigger(availableNow=True).start().awaitTermination()

    for part in range(4):
        arrive(events.where(F.col("event_id") % 4 == (3 * part + 1) % 4))
    # One event far ahead moves the watermark past all others; its own request stays open.
    arrive(spark.range(1).select(F.lit("later").alias("request_id"), F.lit("pending").alias("state"), F.lit("2099-01-01").cast("timestamp").alias("at")))
    return spark.read.schema(states.OUTCOME).parquet(out)


PART = 64 * 1024


@query(
    f"""SELECT 'chain-' || lang AS chain_v, {_CYCLE}, count(*) AS files, CAST(sum(n) AS BIGINT) AS parts, CAST(sum(bytes) AS BIGINT) AS bytes,
          sha256(string_agg(digest, '' ORDER BY doc_id)) AS digests,
          sha256(string_agg(parts_sha256, '' ORDER BY doc_id)) AS part_digests
        FROM (SELECT lang, source, doc_id, strlen(text) AS bytes, greatest(ceil(strlen(text) / {PART}.0), 1) AS n, sha256(text) AS digest,
                sha256(sha256(sha256(string_agg(sha256(from_hex(substr(hex(encode(text)), k * {2 * PART} + 1, {2 * PART}))), '' ORDER BY k)))) AS parts_sha256
              FROM documents, unnest(range(greatest(CAST(ceil(strlen(text) / {PART}.0) AS BIGINT), 1))) AS places(k) GROUP BY ALL)
        GROUP BY lang, source"""
)
def ranged_file_scan(spark, root):
    """Documents as files, read by ranges of 64 kB and in order; no row holds a file."""
    base = new_folder(spark, "ranged")
    put_files(package_chunks(spark, root, F.lit(False)).where(F.col("path").endswith(".txt")), base)
    found = placed_files(written(listing.listed(spark, base), "ranged-listing"), base)
    whole = listing.file_digests(found).select(*passes.FILE, "bytes", "actual_sha256")
    by_part = listing.part_list_digest(listing.file_parts(found, PART), passes.FILE).drop("bytes")
    met = whole.join(by_part, passes.FILE).withColumn("doc_id", F.regexp_extract("rel_path", r"^(\d+)", 1).cast("bigint"))

    def in_order(digest: str):
        return listing.ordered_digest(F.col("doc_id"), F.col(digest))

    return met.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n_parts").alias("parts"), F.sum("bytes").alias("bytes"),
        in_order("actual_sha256").alias("digests"), in_order("parts_sha256").alias("part_digests"),
    )


# Header and line of each kind of chart; %-marks: clock, millis, value, user, missing every seventh.
_CHARTS = {
    "click": ("p-system_cpu-converted", [" timestamp ", "user (%)", " system (%)", "anomaly%", "annotations"], ["clock", "value", "gap", "none", "note"]),
    "view": ("p-mem_available-raw", ["timestamp", "avail (B)", "annotations"], ["millis", "user", "none"]),
    "purchase": ("r-io_stall-raw", ["timestamp", "timestamp", "anomaly%"], ["millis", "value", "none"]),
    "error": ("r-net-converted", ["timestamp", "annotations", "sent (kilobits/s)", "Active(anon) (GiBy)", ""], ["clock", "note", "user", "value", "none"]),
}


@query(
    """WITH e AS (SELECT *, TIMESTAMP '2026-06-20' + (date_trunc('second', ts) - date_trunc('day', ts)) AS at_clock, date_trunc('milliseconds', ts)::TIMESTAMP + INTERVAL 7 HOUR AS at_millis FROM events),
       m AS (SELECT 'primary' AS host, 'system_cpu' AS chart, 'user' AS dim, '%' AS unit, at_clock AS ts, value FROM e WHERE event_type = 'click'
         UNION ALL SELECT 'primary', 'system_cpu', 'system', '%', at_clock, value FROM e WHERE event_type = 'click' AND event_id % 7 <> 0
         UNION ALL SELECT 'primary', 'mem_available', 'avail', 'B', at_millis, user_id FROM e WHERE event_type = 'view'
         UNION ALL SELECT 'backup', 'io_stall', 'timestamp_2', NULL, at_millis, value FROM e WHERE event_type = 'purchase'
         UNION ALL SELECT 'backup', 'net', 'sent', 'kilobits/s', at_clock, user_id FROM e WHERE event_type = 'error'
         UNION ALL SELECT 'backup', 'net', 'Active(anon)', 'GiBy', at_clock, value FROM e WHERE event_type = 'error')
       SELECT host, chart, dim, unit, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_at, max(ts) AS last_at FROM m GROUP BY ALL"""
)
def metric_charts(spark, root):
    """Events as charts with four kinds of header, read back by the names in them."""
    events = table(spark, root, "events").where(F.col("event_type").isin(*_CHARTS))
    made = {
        "clock": F.date_format("ts", "HH:mm:ss"), "millis": F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
        "value": F.concat(F.lit(" "), F.col("value").cast("string")), "user": F.col("user_id").cast("string"), "none": F.lit(""),
        "gap": F.when(F.col("event_id") % 7 == 0, "-").otherwise(F.col("value").cast("string")), "note": F.lit('"a, quoted note"'),
    }
    body = first = name = None
    for kind, (file, header, line) in _CHARTS.items():
        is_kind = F.col("event_type") == kind
        texts = F.concat_ws(",", *[made[c] for c in line]), F.lit(",".join(header)), F.lit(f"{file}.csv")
        body, first, name = (
            F.when(is_kind, t) if so_far is None else so_far.when(is_kind, t) for so_far, t in zip((body, first, name), texts)
        )
    rows = events.select(name.alias("path"), F.col("event_id").alias("chunk_no"), F.concat(body, F.lit("\n")).cast("binary").alias("chunk"))
    headers = events.select(name.alias("path"), F.lit(-1).cast("bigint").alias("chunk_no"), F.concat(first, F.lit("\n")).cast("binary").alias("chunk")).distinct()
    base = new_folder(spark, "charts")
    put_files(headers.unionByName(rows), base)
    return charts.metric_charts(spark, base, "2026-06-20").groupBy("host", "chart", "dim", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )


@query(
    f"""SELECT DISTINCT 'chain-' || lang AS chain_v, {_CYCLE}, lang AS chain_version, 'mongo' AS components,
          strftime(TIMESTAMP '2026-06-01 08:00:00' + to_days(CAST(regexp_extract(source, '[0-9]+$') AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS cycle_timestamp,
          TIMESTAMP '2026-06-01 01:00:00' + to_days(CAST(regexp_extract(source, '[0-9]+$') AS INTEGER)) AS cycle_at FROM documents"""
)
def manifest_scan(spark, root):
    """Manifest documents of packages, with their instants."""
    base = new_folder(spark, "manifests")
    put_files(package_chunks(spark, root, F.lit(False)).where(F.col("path").endswith(integrity.MANIFEST_FILE)), base)
    stamped = packages.manifest_stamps(packages.manifests(spark, base))
    return stamped.select(
        *KEY, F.col("manifest_summary.chain_version").alias("chain_version"), F.array_join("manifest_summary.components", ",").alias("components"),
        "cycle_timestamp", F.col("cycle_at").cast("timestamp_ntz").alias("cycle_at"),
    )


@query(
    f"""SELECT 'chain-' || lang AS chain_v, {_CYCLE}, count(*) FILTER (doc_id % 97 <> 0) AS files_ok, count(*) FILTER (doc_id % 97 = 0) AS files_failed,
          count(*) FILTER (doc_id % 97 = 0) = 0 AS ready FROM documents GROUP BY ALL"""
)
def package_readiness_scan(spark, root):
    """Packages as files, some altered: their lists, their contents, and which are ready."""
    base = new_folder(spark, "ready-packages")
    put_files(package_chunks(spark, root, F.col("doc_id") % 97 == 0), base)
    found = written(packages.digested_files(spark, base), "package-files")
    judged = integrity.readiness(found, packages.checksum_lists(spark, base))
    return judged.select(*KEY, "files_ok", "files_failed", "ready")


@query("SELECT CAST(c_custkey AS VARCHAR) AS request_id, CAST(c_custkey % 9 + 1 AS BIGINT) AS chain FROM customer WHERE c_custkey % 3 <> 0")
def request_file_scan(spark, root):
    """Request files of which some have a done marker; those that have none are open."""
    k, base = F.col("c_custkey"), new_folder(spark, "request-files")
    name = k.cast("string")
    customers = table(spark, root, "customer")
    body = F.to_json(F.struct(F.lit("chain-v1").alias("version"), (k % 9 + 1).alias("chain")))
    requests = customers.select(F.concat(F.lit("in/"), name, F.lit(".json")).alias("path"), F.lit(0).alias("chunk_no"), body.cast("binary").alias("chunk"))
    done = customers.where(k % 3 == 0).select(F.concat(F.lit("in/"), name, F.lit(".done")).alias("path"), F.lit(0).alias("chunk_no"), F.lit(b"ok").alias("chunk"))
    put_files(requests.unionByName(done), base)
    return packages.open_requests(spark, f"{base}/in").select("request_id", F.get_json_object("body", "$.chain").cast("bigint").alias("chain"))


@query(
    """SELECT 'chain-v' || (o_custkey % 3 + 1) AS chain_v, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id, 'AES-256-GCM' AS alg,
         CASE WHEN o_orderkey % 5 <> 0 THEN '2026-06-20T01:00:00' END AS cycle_timestamp, CAST(1 + o_orderkey % 2 AS BIGINT) AS copies FROM orders"""
)
def catalog_documents_append(spark, root):
    """Catalog documents appended in two writes, the second of which repeats some; absent values are left out."""
    k = F.col("o_orderkey")
    rows = table(spark, root, "orders").select(
        F.lit(crypto.ALGORITHM).alias("alg"), F.concat(F.lit("chain-v"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("chain_v"),
        F.lpad(k.cast("string"), 12, "0").alias("cycle_id"), F.when(k % 5 != 0, "2026-06-20T01:00:00").alias("cycle_timestamp"), k.alias("_k"),
    )
    path = new_folder(spark, "catalog-documents")
    sinks.append_documents(rows.drop("_k"), path)
    sinks.append_documents(rows.where("_k % 2 = 1").drop("_k"), path)
    back = packages.catalog_documents(spark, path, pattern="*", multi_line=False)
    return back.groupBy("chain_v", "cycle_id", "alg", "cycle_timestamp").agg(F.count(F.lit(1)).alias("copies"))
