"""Queries on digests, encryption, packages, catalogs, ledgers and requests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cycle_analytics.functions import crypto, documents, text
from cycle_analytics.operators import chunks, integrity, ledger, requests
from cycle_analytics.plans.registry import cents, padded_id, query
from cycle_analytics.session import new_folder
from cycle_analytics.sources.packages import cycle_progress, log_lines
from cycle_analytics.sources.tables import table

CHUNK_BYTES = 4096
# A fixed dummy key for the queries; real passes take theirs from the environment.
DUMMY_KEY = bytes(range(32))

_PLACE = "'chain-' || lang AS chain_v, source AS cycle_id, doc_id || '.txt' AS rel_path"


def document_files(spark, root):
    """Documents as files of packages: chain by language, cycle by source."""
    return table(spark, root, "documents").select(
        F.concat(F.lit("chain-"), "lang").alias("chain_v"), F.col("source").alias("cycle_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
        "doc_id", F.col("text").cast("binary").alias("content"),
    )


def _expected_and_actual(spark, root):
    """Checksum lists in which some digests are wrong and some files are gone."""
    hashed = document_files(spark, root).withColumn("actual_sha256", integrity.content_digest(F.col("content"))).drop("content")
    digest = F.when(F.col("doc_id") % 17 == 0, F.lit("0" * 64)).otherwise(F.col("actual_sha256"))
    marker = F.when(F.col("doc_id") % 2 == 0, " *").otherwise("  ")
    lines = hashed.select("chain_v", "cycle_id", F.explode(F.array(F.concat(digest, marker, "rel_path"), F.lit("# note"), F.lit("  "))).alias("value"))
    expected = integrity.checksum_lines(lines)
    actual = hashed.where(F.col("doc_id") % 23 != 0)
    return expected, actual


_STATUS = f"""f AS (SELECT {_PLACE}, doc_id,
         CASE WHEN doc_id % 23 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'altered' ELSE 'ok' END AS status FROM documents)"""


@query(
    f"""WITH {_STATUS} SELECT chain_v, cycle_id, count(*) FILTER (status = 'ok') AS files_ok,
          count(*) FILTER (status <> 'ok') AS files_failed FROM f GROUP BY ALL"""
)
def checksum_verify(spark, root):
    expected, actual = _expected_and_actual(spark, root)
    return integrity.package_report(integrity.verified(expected, actual))


@query(f"WITH {_STATUS} SELECT chain_v, cycle_id, rel_path, status FROM f")
def checksum_status(spark, root):
    expected, actual = _expected_and_actual(spark, root)
    return integrity.verified(expected, actual).select("chain_v", "cycle_id", "rel_path", "status")


@query(
    f"""WITH {_STATUS}, r AS (SELECT cycle_id, doc_id, rel_path || ': FAILED' || CASE status WHEN 'missing' THEN ' open or read' ELSE '' END AS line,
          row_number() OVER (PARTITION BY cycle_id ORDER BY doc_id DESC) AS k FROM f WHERE status <> 'ok')
        SELECT cycle_id, string_agg(line, ' | ' ORDER BY doc_id) AS tail FROM r WHERE k <= 5 GROUP BY cycle_id"""
)
def failure_tail(spark, root):
    expected, actual = _expected_and_actual(spark, root)
    failed = integrity.verified(expected, actual).where(F.col("status").isin("altered", "missing"))
    lines = failed.select(
        "cycle_id", F.regexp_extract("rel_path", r"^(\d+)", 1).cast("bigint").alias("doc_id"),
        F.concat("rel_path", F.lit(": FAILED"), F.when(F.col("status") == "missing", " open or read").otherwise("")).alias("line"),
    )
    return integrity.failure_tail(lines, ["cycle_id"], "doc_id", "line")


@query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS INTEGER) AS bytes FROM documents")
def content_hash(spark, root):
    content = F.col("text").cast("binary")
    return table(spark, root, "documents").select(
        "doc_id", integrity.content_digest(content).alias("digest"), F.octet_length(content).alias("bytes")
    )


def _document_chunks(spark, root):
    return chunks.chunked(document_files(spark, root), "content", CHUNK_BYTES)


_IDENTITY = ["chain_v", "cycle_id", "rel_path", "chunk_no"]


def _stored_artifacts(spark, root):
    """Encrypted chunks, written once so that nonce and tag are those of the stored bytes."""
    rows = _document_chunks(spark, root).withColumn("plain_sha256", F.sha2("chunk", 256)).withColumn("plain_bytes", F.length("chunk"))
    sealed = crypto.encrypted(rows, crypto.key_ring(spark, key=DUMMY_KEY), "chunk", crypto.chunk_identity(*_IDENTITY))
    path = new_folder(spark, "artifacts")
    # Rebalancing splits a package that outgrows a partition and joins small ones.
    sealed.hint("rebalance", "chain_v", "cycle_id").write.partitionBy("chain_v").parquet(path)
    return spark.read.schema(sealed.schema).parquet(path)


_CHUNKS = f"greatest(CAST(ceil(strlen(text) / {CHUNK_BYTES}.0) AS BIGINT), 1)"


@query(
    f"SELECT doc_id, {_CHUNKS} AS n_chunks, true AS overhead_ok, true AS identical, CAST(strlen(text) AS BIGINT) AS plain_bytes FROM documents"
)
def aes_roundtrip(spark, root):
    stored = _stored_artifacts(spark, root)
    opened = crypto.decrypted(stored, crypto.key_ring(spark, key=DUMMY_KEY), "artifact", crypto.chunk_identity(*_IDENTITY))
    overhead = F.length("artifact") - F.col("plain_bytes") == crypto.NONCE_BYTES + crypto.TAG_BYTES
    same = F.coalesce(F.sha2("content", 256) == F.col("plain_sha256"), F.lit(False))
    return opened.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.bool_and(overhead).alias("overhead_ok"), F.bool_and(same).alias("identical"),
        F.sum("plain_bytes").cast("bigint").alias("plain_bytes"),
    )


@query(
    f"""WITH c AS (SELECT doc_id % 4 AS k, {_CHUNKS} AS n FROM documents)
        SELECT CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'nonce' WHEN 2 THEN 'tag' ELSE 'moved' END AS tampering,
          CAST(sum(n) AS BIGINT) AS n_chunks, CASE WHEN k = 0 THEN 0 ELSE CAST(sum(n) AS BIGINT) END AS rejected FROM c GROUP BY k"""
)
def tamper_detection(spark, root):
    stored = _stored_artifacts(spark, root)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("none", "nonce", "tag", "moved")]), (F.col("doc_id") % 4 + 1).cast("int"))

    def other(byte):
        zero, full = F.unhex(F.lit("00")), F.unhex(F.lit("FF"))
        return F.when(byte == zero, full).otherwise(zero)

    sealed, size = F.col("artifact"), F.length("artifact")
    bad_nonce = F.concat(other(F.substring(sealed, 1, 1)), F.substring(sealed, F.lit(2), size))
    bad_tag = F.concat(F.substring(sealed, F.lit(1), size - 1), other(F.substring(sealed, -1, 1)))
    changed = stored.withColumn("tampering", kind).withColumns(
        {
            "artifact": F.when(F.col("tampering") == "nonce", bad_nonce).when(F.col("tampering") == "tag", bad_tag).otherwise(sealed),
            "chunk_no": F.when(F.col("tampering") == "moved", F.col("chunk_no") + 1).otherwise(F.col("chunk_no")),
        }
    )
    opened = crypto.decrypted(changed, crypto.key_ring(spark, key=DUMMY_KEY), "artifact", crypto.chunk_identity(*_IDENTITY))
    return opened.groupBy("tampering").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("content").isNull()).alias("rejected"))


@query(
    f"""SELECT 'chain-' || lang AS chain_v, source AS cycle_id, CAST(sum({_CHUNKS}) AS BIGINT) AS n_chunks,
          24 AS nonce_digits, 32 AS tag_digits, true AS key_ok, false AS short_key_ok,
          source || '.tar.aes256gcm' AS artifact_name, source || '.tar.aes256gcm.meta.json' AS metadata_name,
          '{{"alg":"AES-256-GCM","chain_v":"chain-' || lang || '","cycle_id":"' || source || '","plaintext":"chunks"}}' AS document
        FROM documents GROUP BY lang, source"""
)
def artifact_meta(spark, root):
    stored = _stored_artifacts(spark, root)
    keys = [("MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY=", "key_ok"), ("c2hvcnQ=", "short_key_ok")]
    per_cycle = stored.groupBy("chain_v", "cycle_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.max(F.length(crypto.nonce_hex(F.col("artifact")))).alias("nonce_digits"),
        F.max(F.length(crypto.tag_hex(F.col("artifact")))).alias("tag_digits"),
    )
    document = F.struct(F.lit(crypto.ALGORITHM).alias("alg"), "chain_v", "cycle_id", F.lit("chunks").alias("plaintext"))
    return per_cycle.select(
        "*", *[crypto.key_is_valid(F.lit(k)).alias(n) for k, n in keys],
        text.artifact_name(F.col("cycle_id")).alias("artifact_name"), text.metadata_name(F.col("cycle_id")).alias("metadata_name"),
        F.to_json(document).alias("document"),
    )


@query(
    """WITH u AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)(/.*)?$', 1) AS host, page_id,
           ltrim(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '/') AS p FROM pages),
       q AS (SELECT host, CASE page_id % 20 WHEN 0 THEN '/' || p WHEN 1 THEN p || '/../x' WHEN 2 THEN '\\' || p WHEN 3 THEN p || '/..x' ELSE p END AS path FROM u),
       s AS (SELECT host, starts_with(path, '/') OR starts_with(path, '\\') OR list_contains(string_split(path, '/'), '..') AS bad FROM q)
       SELECT host, count(*) AS members, count(*) FILTER (bad) AS unsafe_members, bool_or(bad) AS rejected FROM s GROUP BY host"""
)
def path_safety(spark, root):
    bare = F.ltrim(F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1), F.lit("/"))
    k = F.col("page_id") % 20
    path = (
        F.when(k == 0, F.concat(F.lit("/"), bare)).when(k == 1, F.concat(bare, F.lit("/../x")))
        .when(k == 2, F.concat(F.lit("\\"), bare)).when(k == 3, F.concat(bare, F.lit("/..x"))).otherwise(bare)
    )
    files = table(spark, root, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)(/.*)?$", 1).alias("host"), path.alias("path"))
    return integrity.unsafe_packages(files, text.unsafe_path(F.col("path")), ["host"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'chain-v' || (o_orderkey % 3) END AS chain_version,
         concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'pg_basebackup' END, CASE WHEN o_orderstatus <> 'P' THEN 'mongo' END,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'pfc' END, 'files') AS components,
         CASE WHEN o_orderkey % 5 = 0 OR o_orderstatus = 'P' THEN CAST(o_custkey AS DOUBLE)
              ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) + o_custkey AS DOUBLE) END AS raw_bytes
       FROM orders"""
)
def manifest_summary(spark, root):
    orders = table(spark, root, "orders")
    has_pfc = F.col("o_orderkey") % 5 != 0
    no_sizes = F.create_map().cast("map<string,bigint>")
    pfc = F.when(has_pfc & (F.col("o_orderstatus") == "P"), no_sizes).when(
        has_pfc, F.create_map(F.lit("a.bin"), cents("o_totalprice"), F.lit("b.bin"), F.col("o_custkey"))
    )
    files = F.create_map(F.lit("c.bin"), F.col("o_custkey"))
    present = {
        "pg_basebackup": F.col("o_orderstatus") == "F", "mongo": F.col("o_orderstatus") != "P", "pfc": has_pfc, "files": F.lit(True),
    }
    chain = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("chain-v"), (F.col("o_orderkey") % 3).cast("string")))
    summary = documents.manifest_summary({"chain_version": chain}, present, pfc, files)
    return orders.select("o_orderkey", summary.alias("s")).select(
        "o_orderkey", "s.chain_version", F.array_join("s.components", ",").alias("components"),
        F.col("s.unstructured_raw_bytes").cast("double").alias("raw_bytes"),
    )


# Request bodies by remainder: every rule of the request check has its case.
REQUEST_BODIES = [
    '{{"version":"chain-v{c}","chain":{n},"source":"local","send_to_vm1":true}}',
    '{{"chain_v":" chain-v{c} ","chain":"{n}","source":"general","send_to_vm1":"no"}}',
    '{{"version":"","chain":{n}}}',
    '{{"version":"  ","chain_v":"chain-v{c}","chain":{n}}}',
    '{{"version":"chain-v{c}","chain":0}}',
    '{{"version":"chain-v{c}","chain":"3x"}}',
    '{{"version":"chain-v{c}"}}',
    '{{"version":"chain-v{c}","chain":{n},"source":"cloud"}}',
    '{{"version":"chain-v{c}","chain":{n},"send_to_vm1":0,"vm1_dest_root":" /restore "}}',
    '{{"version":"chain-v{c}","chain":2.9,"send_to_vm1":"","vm1_dest_root":""}}',
    '{{"version":7,"chain":{n}}}',
    'not json {c} {n}',
]


def request_bodies(spark, root):
    """One request document per order."""
    orders = table(spark, root, "orders")
    c, n = (F.col("o_orderkey") % 3 + 1).cast("string"), (F.col("o_orderkey") % 9 + 1).cast("string")
    text_of = None
    for remainder, body in enumerate(REQUEST_BODIES):
        pieces = re.split(r"(\{\{|\}\}|\{c\}|\{n\})", body)
        marks = {"{{": F.lit("{"), "}}": F.lit("}"), "{c}": c, "{n}": n}
        value = F.concat(*[marks.get(piece, F.lit(piece)) for piece in pieces if piece])
        is_kind = F.col("o_orderkey") % len(REQUEST_BODIES) == remainder
        text_of = F.when(is_kind, value) if text_of is None else text_of.when(is_kind, value)
    return orders.select(F.col("o_orderkey").alias("request_id"), "o_custkey", text_of.alias("body"))


def _request_case(values: dict[int, str], default: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in values.items())
    return f"CASE o_orderkey % {len(REQUEST_BODIES)} {cases} ELSE {default} END"


_CHAIN, _N = "'chain-v' || (o_orderkey % 3 + 1)", "CAST(o_orderkey % 9 + 1 AS DOUBLE)"
REQUEST_SQL = f"""SELECT o_orderkey AS request_id, o_custkey,
    {_request_case({2: "'missing_version'", 3: "'missing_version'", 10: "'missing_version'", 4: "'chain_below_one'", 5: "'chain_not_integer'", 6: "'missing_chain'", 7: "'invalid_source'", 11: "'parse_error'"}, 'NULL')} AS error_reason,
    {_request_case({2: 'NULL', 3: 'NULL', 10: 'NULL', 11: 'NULL'}, _CHAIN)} AS version,
    {_request_case({4: '0.0', 5: 'NULL', 6: 'NULL', 9: '2.0', 11: 'NULL'}, _N)} AS chain_n,
    {_request_case({1: "'general'", 7: "'cloud'"}, "'local'")} AS source,
    {_request_case({1: 'false', 8: 'false', 9: 'false'}, 'true')} AS send,
    {_request_case({8: "'/restore'"}, "'/incoming'")} AS dest_root FROM orders"""


@query(REQUEST_SQL)
def request_validation(spark, root):
    checked = documents.parsed_requests(request_bodies(spark, root), "body", "/incoming")
    return checked.drop("body").withColumn("chain_n", F.col("chain_n").cast("double"))


@query(
    f"""WITH q AS ({REQUEST_SQL}), v AS (SELECT * FROM q WHERE error_reason IS NULL),
        c AS (SELECT 'chain-v' || (o_custkey % 3 + 1) AS version, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id FROM orders WHERE o_orderstatus = 'F'),
        k AS (SELECT version, cycle_id, row_number() OVER (PARTITION BY version ORDER BY cycle_id) AS replay_order,
                CAST(count(*) OVER (PARTITION BY version) AS BIGINT) AS available FROM c)
        SELECT v.request_id, v.version, k.cycle_id, k.replay_order, v.source, k.available,
               CAST(least(v.chain_n, k.available) AS BIGINT) AS selected
        FROM v JOIN k ON v.version = k.version AND k.replay_order <= v.chain_n"""
)
def restore_plan_preview(spark, root):
    from cycle_analytics.plans.restore import restore_plan

    checked = documents.parsed_requests(request_bodies(spark, root), "body", "/incoming").where("error_reason is null")
    catalog = table(spark, root, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("chain-v"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("chain_v"), padded_id("o_orderkey").alias("cycle_id")
    )
    return restore_plan(checked, catalog).select("request_id", "version", "cycle_id", "replay_order", "source", "available", "selected")


@query(
    """WITH e AS (SELECT strftime(ts, '%Y%m%d%H') AS request_id, ts, event_id,
           CASE event_type WHEN 'click' THEN 'inprogress' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'pending' END AS state FROM events),
       o AS (SELECT request_id, min(ts) AS opened, arg_max(state, ts) AS last_state, min(ts) FILTER (state IN ('done', 'error')) AS ended,
           arg_min(state, ts) FILTER (state IN ('done', 'error')) AS outcome FROM e GROUP BY 1)
       SELECT request_id, last_state, CASE WHEN epoch_us(ended) - epoch_us(opened) < 1200000000 THEN outcome ELSE 'timeout' END AS outcome,
         CASE WHEN epoch_us(ended) - epoch_us(opened) < 1200000000 THEN (epoch_us(ended) - epoch_us(opened)) / 1000000.0::DOUBLE ELSE 1200.0 END AS waited_s FROM o"""
)
def request_state(spark, root):
    events = table(spark, root, "events")
    state = (
        F.when(F.col("event_type") == "click", "inprogress").when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "error", "error").otherwise("pending")
    )
    status = events.select(F.date_format("ts", "yyyyMMddHH").alias("request_id"), state.alias("state"), "ts", "event_id")
    return requests.request_states(status, "request_id", "state", "ts", "event_id", timeout_seconds=1200)


def _order_cycles(spark, root):
    return table(spark, root, "orders").select(
        F.concat(F.lit("chain-v"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("chain_v"), padded_id("o_orderkey").alias("cycle_id"),
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("at"), "o_totalprice",
    )


def _order_ledger(spark, root):
    """Done for finished orders; uploads per target, some rows twice as after a retry."""
    orders = _order_cycles(spark, root)
    done = orders.where("o_orderstatus = 'F'").select(
        "chain_v", "cycle_id", F.lit("done").alias("stage"), F.lit(None).cast("string").alias("target"), "at",
        F.lit(0.0).alias("seconds"), F.lit(False).alias("reused"),
    )
    sent = orders.where("o_orderstatus <> 'P'").select(
        "chain_v", "cycle_id", F.lit("uploaded").alias("stage"),
        F.explode(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("general"), F.lit("immutable"), F.lit("general"))).otherwise(F.array(F.lit("general")))).alias("target"),
        "at", (F.floor("o_totalprice") / 4).alias("seconds"), F.lit(False).alias("reused"),
    )
    return done.unionByName(sent)


_O = "SELECT 'chain-v' || (o_custkey % 3 + 1) AS chain_v, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id"


@query(f"{_O} FROM orders WHERE o_orderstatus <> 'F'")
def pending_cycles(spark, root):
    return ledger.pending(_order_cycles(spark, root), _order_ledger(spark, root)).select("chain_v", "cycle_id")


@query(f"{_O} FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_custkey % 7 <> 0")
def purge_eligible(spark, root):
    cycles = _order_cycles(spark, root)
    metadata = cycles.where("o_orderkey % 4 <> 0")
    ready = cycles.withColumn("ready", F.col("o_custkey") % 7 != 0)
    return ledger.purge_eligible(_order_ledger(spark, root), cycles, metadata, ready)


@query(
    f"""{_O}, t.target FROM orders CROSS JOIN (VALUES ('general'), ('immutable')) t(target)
        WHERE o_orderkey % 4 <> 0 AND NOT (o_orderstatus <> 'P' AND (t.target = 'general' OR o_orderkey % 2 = 0))"""
)
def replication_backlog(spark, root):
    cycles = _order_cycles(spark, root)
    return ledger.upload_backlog(cycles, cycles.where("o_orderkey % 4 <> 0"), _order_ledger(spark, root), ["general", "immutable"])


@query(
    """SELECT 'chain-v' || (o_custkey % 3 + 1) AS chain_v, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS cycle_id,
         floor(o_totalprice) / 4.0::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS upload_seconds,
         CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS targets FROM orders WHERE o_orderstatus <> 'P'"""
)
def ledger_stage_seconds(spark, root):
    return ledger.stage_seconds(_order_ledger(spark, root))


@query(
    f"""WITH c AS ({_O}, o_orderkey, o_orderstatus FROM orders)
        SELECT chain_v, cycle_id, o_orderstatus <> 'P' AS has_artifact, o_orderkey % 4 <> 0 AS has_catalog, o_orderstatus = 'F' AS has_done,
          o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AS consistent FROM c WHERE o_orderstatus <> 'P' OR o_orderkey % 4 <> 0"""
)
def catalog_reconciliation(spark, root):
    cycles = _order_cycles(spark, root)
    return integrity.reconciled(
        cycles.where("o_orderstatus <> 'P'"), cycles.where("o_orderkey % 4 <> 0"), cycles.where("o_orderstatus = 'F'")
    )


@query(
    """WITH l AS (SELECT conv_id, TIMESTAMP '2026-06-20 01:00:00' + to_seconds(CAST(conv_id * 100 + turn * 7 AS BIGINT)) AS said_at, role FROM conversations),
       p AS (SELECT conv_id, min(said_at) FILTER (role = 'user') AS started_at, max(said_at) FILTER (role = 'assistant') AS ended_at FROM l WHERE role IN ('user', 'assistant') GROUP BY 1)
       SELECT 'chain-v' || (conv_id % 3 + 1) AS chain_v, CAST(conv_id AS VARCHAR) AS cycle_id, started_at, ended_at,
         (epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS seconds FROM p"""
)
def log_progress_pairs(spark, root):
    turns = table(spark, root, "conversations")
    offset = (F.col("conv_id") * 100 + F.col("turn") * 7).cast("int")
    at = F.lit("2026-06-20 01:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))
    name = F.concat(F.lit("chain-v"), (F.col("conv_id") % 3 + 1).cast("string"), F.lit("/"), F.col("conv_id").cast("string"))
    message = (
        F.when(F.col("role") == "user", F.concat(F.lit("━━ processing cycle "), name, F.lit(" ━━")))
        .when(F.col("role") == "assistant", F.concat(F.lit("<GOOD> ━━ done cycle "), name, F.lit(" ━━")))
        .otherwise(F.concat(F.lit("<INFO> cycle "), name, F.lit(" not ready (checksums failed)")))
    )
    lines = turns.select(F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0700] "), message).alias("value"))
    return cycle_progress(log_lines(lines, "value"))


@query(
    """WITH b AS (SELECT doc_id, lang, source, text, unnest(range(greatest(CAST(ceil(length(text) / 512.0) AS BIGINT), 1))) AS chunk_no FROM documents),
       c AS (SELECT lang, source, doc_id, chunk_no, sha256(substr(text, chunk_no * 512 + 1, 512)) AS chunk_sha256 FROM b),
       f AS (SELECT lang, chunk_sha256, min(doc_id) AS first_doc, count(*) AS copies FROM c GROUP BY ALL)
       SELECT first_doc, CAST(count(*) AS BIGINT) AS stored_chunks, CAST(sum(copies) AS BIGINT) AS references FROM f GROUP BY first_doc"""
)
def chunk_dedup(spark, root):
    docs = table(spark, root, "documents").select("lang", "doc_id", "text")
    pieces = chunks.with_digest(chunks.chunked(docs, "text", 512))
    stored = chunks.first_stored(pieces, ["lang"], ["doc_id", "chunk_no"])
    return stored.groupBy(F.col("first.doc_id").alias("first_doc")).agg(
        F.count(F.lit(1)).alias("stored_chunks"), F.sum("copies").alias("references")
    )


@query(
    f"""SELECT doc_id, {_CHUNKS} AS applied_chunks, {_CHUNKS} AS verified_ok_chunks, 0 AS verified_fail_chunks FROM documents"""
)
def chunk_apply(spark, root):
    """Two versions of every chunk, of which the newer wins and must match the source again."""
    current = _document_chunks(spark, root).withColumn("version", F.lit(2))
    older = current.withColumns({"version": F.lit(1), "chunk": F.concat(F.col("chunk"), F.lit("old").cast("binary"))})
    place = ["doc_id", "chunk_no"]
    latest = chunks.latest_chunks(older.unionByName(current), place, "version", ["chunk"])
    listed = current.select(*place, F.sha2("chunk", 256).alias("expected"))
    applied = latest.withColumn("actual", F.sha2("chunk", 256)).join(listed, place)
    return chunks.verified_counts(applied, ["doc_id"], "expected", "actual")
