"""Queries on the contents of two stores: hash trees, history filters, mirrors and replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from cycle_analytics.functions import crypto
from cycle_analytics.operators import delta, hash_tree
from cycle_analytics.operators.history import ChunkHistory
from cycle_analytics.plans import replicas
from cycle_analytics.plans.integrity_queries import _CHUNKS, CHUNK_BYTES, DUMMY_KEY, _stored_artifacts
from cycle_analytics.plans.registry import query
from cycle_analytics.plans.restore import restore_plan
from cycle_analytics.session import new_folder, written
from cycle_analytics.sources.mirror import Mirror
from cycle_analytics.sources.sinks import assembled_files
from cycle_analytics.sources.tables import table
from cycle_analytics.streaming import service

CHUNK_CHARS = 512


def text_chunks(docs):
    """Documents (lang, source, rel_path, text) as chunk rows with digests."""
    n = F.greatest(F.ceil(F.length("text") / F.lit(CHUNK_CHARS)), F.lit(1)).cast("int")
    rows = docs.select(
        F.concat(F.lit("chain-"), "lang").alias("chain_v"), F.col("source").alias("cycle_id"), "rel_path", "text",
        F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"),
    )
    chunk = F.substring("text", F.col("chunk_no") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))
    return rows.select(
        *hash_tree.FILE, "chunk_no", F.sha2(chunk.cast("binary"), 256).alias("chunk_sha256"),
        F.octet_length(chunk).cast("bigint").alias("bytes"),
    )


# In two chains some files are altered, lost, moved, or new.
_KINDS = """CASE WHEN lang NOT IN ('de', 'fr') THEN 'same' WHEN doc_id % 5 = 0 THEN 'altered' WHEN doc_id % 7 = 0 THEN 'lost'
    WHEN doc_id % 11 = 0 THEN 'renamed' WHEN doc_id % 13 = 0 THEN 'extra' ELSE 'same' END"""


@query(
    f"""WITH k AS (SELECT 'chain-' || lang AS chain_v, source AS cycle_id, doc_id || '.txt' AS rel_path, text, strlen(text) AS n, {_KINDS} AS kind FROM documents),
       gone AS (SELECT chain_v, text, count(*) AS c FROM k WHERE kind IN ('lost', 'renamed') GROUP BY ALL),
       new AS (SELECT chain_v, text, count(*) AS c, max(path) AS path FROM (
           SELECT chain_v, text, cycle_id || '/moved/' || rel_path AS path FROM k WHERE kind = 'renamed'
           UNION ALL SELECT chain_v, 'x' || text, cycle_id || '/new-' || rel_path FROM k WHERE kind = 'extra') GROUP BY ALL),
       one AS (SELECT chain_v, text, path FROM gone JOIN new USING (chain_v, text) WHERE gone.c = 1 AND new.c = 1)
       SELECT chain_v, cycle_id, rel_path, 'altered' AS status, NULL AS other_path, n AS left_bytes, n + 1 AS right_bytes FROM k WHERE kind = 'altered'
       UNION ALL SELECT chain_v, cycle_id, rel_path, CASE WHEN one.path IS NULL THEN 'lost' ELSE 'renamed' END, one.path, n, NULL
         FROM k LEFT JOIN one USING (chain_v, text) WHERE kind IN ('lost', 'renamed')
       UNION ALL SELECT chain_v, cycle_id, 'moved/' || rel_path, 'extra', NULL, NULL, n FROM k LEFT JOIN one USING (chain_v, text) WHERE kind = 'renamed' AND one.path IS NULL
       UNION ALL SELECT k.chain_v, cycle_id, 'new-' || rel_path, 'extra', NULL, NULL, n + 1 FROM k LEFT JOIN one ON one.chain_v = k.chain_v AND one.text = 'x' || k.text
         WHERE kind = 'extra' AND one.path IS NULL"""
)
def content_reconciliation(spark, root):
    """Files that differ between a store and its copy, found by comparing hash trees from the roots down."""
    docs = table(spark, root, "documents").select(
        "lang", "source", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.expr(_KINDS).alias("kind")
    )
    kind, path = F.col("kind"), F.col("rel_path")
    copy = docs.withColumns(
        {
            "rel_path": F.when(kind == "renamed", F.concat(F.lit("moved/"), path)).otherwise(path),
            "text": F.when(kind == "altered", F.concat(F.lit("x"), "text")).otherwise(F.col("text")),
        }
    ).where("kind <> 'lost'")
    extra = docs.where("kind = 'extra'").withColumns({"rel_path": F.concat(F.lit("new-"), "rel_path"), "text": F.concat(F.lit("x"), "text")})
    base = new_folder(spark, "trees")
    trees = [
        hash_tree.HashTree(spark, f"{base}/{name}").add(text_chunks(rows))
        for name, rows in (("left", docs), ("right", copy.unionByName(extra)))
    ]
    return hash_tree.compared(*trees)


_BLOCKS = f"""b AS (SELECT lang, doc_id, sha256(substr(text, k * {CHUNK_CHARS} + 1, {CHUNK_CHARS})) AS d
         FROM documents, unnest(range(greatest(CAST(ceil(length(text) / {CHUNK_CHARS}.0) AS BIGINT), 1))) AS places(k))"""


@query(
    f"""WITH {_BLOCKS}, n AS (SELECT DISTINCT lang, d FROM b WHERE doc_id % 10 = 9), h AS (SELECT DISTINCT lang, d FROM b WHERE doc_id % 10 <> 9)
        SELECT 'chain-' || n.lang AS chain_v, count(*) AS new_digests, count(h.d) AS known_digests FROM n LEFT JOIN h ON h.lang = n.lang AND h.d = n.d GROUP BY n.lang"""
)
def chunk_dedup_history(spark, root):
    """Which chunks of a new batch the chain's history holds, after three earlier batches."""
    docs = table(spark, root, "documents").select("lang", "source", "text", "doc_id", F.col("doc_id").cast("string").alias("rel_path"))
    history = ChunkHistory(spark, new_folder(spark, "history"), blocks=64, shard_digits=1)
    for batch, picked in enumerate(("doc_id % 10 < 4", "doc_id % 10 BETWEEN 4 AND 6", "doc_id % 10 BETWEEN 7 AND 8")):
        history.add(text_chunks(docs.where(picked)), batch)
    fresh = text_chunks(docs.where("doc_id % 10 = 9")).select("chain_v", "chunk_sha256").distinct()
    known = history.known(fresh).withColumn("known", F.lit(True))
    return fresh.join(known, ["chain_v", "chunk_sha256"], "left").groupBy("chain_v").agg(
        F.count(F.lit(1)).alias("new_digests"), F.count("known").alias("known_digests")
    )


@query(
    """SELECT 'chain-' || lang || '/' || doc_id || '.txt' AS path, CAST(strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bytes,
         sha256(CASE WHEN doc_id % 5 = 0 THEN 'x' || text ELSE text END) AS sha256, doc_id % 5 = 0 OR doc_id % 11 = 0 AS written_again
       FROM documents WHERE doc_id % 7 <> 0"""
)
def mirror_publish(spark, root):
    """Three versions of a mirror: one published, one only prepared, one published twice; what readers find."""
    docs = table(spark, root, "documents").select(
        "doc_id", F.concat(F.lit("chain-"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"
    )
    altered = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    mirror = Mirror(spark, new_folder(spark, "mirror"))

    def prepare(version, rows):
        content = rows.select("path", F.lit(0).alias("chunk_no"), F.col("text").cast("binary").alias("chunk"))
        files = content.select("path", F.length("chunk").cast("bigint").alias("bytes"), F.sha2("chunk", 256).alias("sha256"))
        mirror.prepare(version, files, content)

    prepare("v1", docs.where("doc_id % 11 <> 0"))
    mirror.publish("v1")
    prepare("v2", altered.limit(0))  # never published
    prepare("v3", altered.where("doc_id % 7 <> 0"))
    mirror.publish("v3")
    mirror.publish("v3")
    parts = mirror.contents(CHUNK_BYTES)
    held = parts.groupBy("path").agg(F.sum(F.length("chunk")).alias("bytes"))
    listed = mirror.manifest().select("path", "sha256", F.col("place").contains("/data/v3/").alias("written_again"))
    return held.join(listed, "path").select("path", "bytes", "sha256", "written_again")


def damaged_replicas(stored):
    """Three targets that each lost or spoiled something else."""
    spoiled = (F.col("doc_id") % 5 == 0) & (F.col("chunk_no") % 2 == 0)
    return {
        "local": stored.where("doc_id % 3 <> 0"),
        "general": stored.withColumn("artifact", F.when(spoiled, F.reverse(F.hex("artifact")).cast("binary")).otherwise(F.col("artifact"))),
        "immutable": stored.where("doc_id % 7 <> 0"),
    }


_HELD = f"""c AS (SELECT 'chain-' || lang AS chain_v, source AS cycle_id, doc_id, text, k AS chunk_no, doc_id % 3 <> 0 AS l, NOT (doc_id % 5 = 0 AND k % 2 = 0) AS g,
         doc_id % 7 <> 0 AS i FROM documents, unnest(range({_CHUNKS})) AS places(k))"""


@query(
    f"""WITH {_HELD} SELECT chain_v, cycle_id, count(*) AS n_chunks, count(*) FILTER (l) AS from_local, count(*) FILTER (NOT l AND g) AS from_general,
          count(*) FILTER (NOT l AND NOT g AND i) AS from_immutable, count(*) FILTER (NOT l AND NOT g AND NOT i) AS lost,
          count(*) FILTER (NOT l AND (g OR i)) AS healed_local, count(*) FILTER (NOT g AND (l OR i)) AS healed_general, count(*) FILTER (NOT i AND (l OR g)) AS healed_immutable
        FROM c GROUP BY ALL"""
)
def replica_restore(spark, root):
    """Where each chunk comes from when three targets lost different ones, and what heals them."""
    stored, ring = _stored_artifacts(spark, root), crypto.key_ring(spark, key=DUMMY_KEY)
    targets = damaged_replicas(stored)
    judged = written(replicas.judged_replicas(targets, ring), "replica-verdicts")
    due = replicas.due_chunks(stored.groupBy(*replicas.FILE).agg(F.count(F.lit(1)).alias("n_chunks")))
    choice = written(replicas.chosen(judged), "replica-choice")
    healing = replicas.healing_plan(due, judged, choice, list(targets))
    # The rows themselves are sent, opened again where they arrive, and counted there.
    healed = None
    for name in targets:
        rows = crypto.decrypted(replicas.healed_rows(targets, healing, name), ring, "artifact", crypto.chunk_identity(*replicas.CHUNK))
        whole = rows.where(F.sha2("content", 256) == F.col("plain_sha256")).select(*replicas.CYCLE, F.lit(name).alias("target"))
        healed = whole if healed is None else healed.unionByName(whole)
    counted = healed.groupBy(*replicas.CYCLE).agg(*[F.count_if(F.col("target") == n).alias(f"healed_{n}") for n in targets])
    met = due.join(choice, replicas.CHUNK, "left").groupBy(*replicas.CYCLE).agg(
        F.count(F.lit(1)).alias("n_chunks"), *[F.count_if(F.col("replica") == n).alias(f"from_{n}") for n in targets],
        F.count_if(F.col("replica").isNull()).alias("lost"),
    )
    return met.join(counted, replicas.CYCLE, "left").na.fill(0, [f"healed_{n}" for n in targets])


@query(
    f"""WITH {_HELD}, r(chain_v, source, n, send) AS (VALUES ('chain-de', 'local', 4, true), ('chain-en', 'general', 3, true), ('chain-fr', 'immutable', 2, false), ('chain-es', 'local', 30, true)),
        y AS (SELECT c.chain_v, cycle_id, r.source, send, n, bool_and(CASE r.source WHEN 'local' THEN l OR g OR i WHEN 'general' THEN g OR i ELSE i END) AS ok
              FROM c JOIN r USING (chain_v) GROUP BY ALL),
        p AS (SELECT *, bool_and(ok) OVER (PARTITION BY chain_v ORDER BY cycle_id) AS whole, row_number() OVER (PARTITION BY chain_v ORDER BY cycle_id) AS k FROM y)
        SELECT p.chain_v || '/' || cycle_id || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256
        FROM p JOIN documents d ON 'chain-' || lang = p.chain_v AND d.source = cycle_id WHERE k <= n AND whole AND send"""
)
def restore_delivery(spark, root):
    """Requests to plans to files below their destinations, from damaged targets."""
    stored, ring = _stored_artifacts(spark, root), crypto.key_ring(spark, key=DUMMY_KEY)
    base = new_folder(spark, "delivery")
    asked = [("de", "local", 4, True), ("en", "general", 3, True), ("fr", "immutable", 2, False), ("es", "local", 30, True)]
    requests = spark.createDataFrame(
        [(f"r-{lang}", f"chain-{lang}", n, source, send, f"{base}/{source}") for lang, source, n, send in asked],
        "request_id string, version string, chain_n bigint, source string, send boolean, dest_root string",
    )
    sealed = stored.groupBy(*replicas.FILE).agg(F.count(F.lit(1)).alias("n_chunks"))
    plan = restore_plan(requests, stored.select(*replicas.CYCLE).distinct())
    _, delivered = replicas.restored(spark, plan, damaged_replicas(stored), sealed, ring)
    return delivered.select("path", "bytes", "sha256")


BLOCK, PART = 512, 16 * 1024
_EDITED = """CASE doc_id % 3 WHEN 0 THEN substr(text, 1, CAST(length(text) // 2 AS BIGINT)) || 'inserted ' || substr(text, CAST(length(text) // 2 AS BIGINT) + 1)
    WHEN 1 THEN substr(text, 11) ELSE text END"""


@query(
    f"""WITH e AS (SELECT doc_id, text, {_EDITED} AS edited FROM documents)
        SELECT doc_id, CAST(strlen(edited) AS BIGINT) AS bytes, sha256(edited) AS sha256, true AS complete, true AS few_literals FROM e"""
)
def file_delta(spark, root):
    """Edited documents as deltas against the originals, and what the deltas give when they are replayed."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", F.lit(1), half), F.lit("inserted "), F.substring("text", half + 1, F.length("text"))))
        .when(F.col("doc_id") % 3 == 1, F.substring("text", F.lit(11), F.length("text"))).otherwise(F.col("text"))
    )
    docs = table(spark, root, "documents").select("doc_id", F.col("text").cast("binary").alias("old"), edited.cast("binary").alias("new"))
    blocks = written(delta.old_blocks(docs, "doc_id", "old", BLOCK), "delta-blocks")
    parts = written(delta.new_parts(docs, "doc_id", "new", BLOCK, PART), "delta-parts")
    told = delta.instructions(blocks, parts, BLOCK)
    stored = written(delta.with_literals(told, parts, PART), "delta")
    sizes = stored.groupBy("key").agg(
        F.sum("length").alias("told"), F.coalesce(F.sum(F.when(F.col("source").isNull(), F.col("length"))), F.lit(0)).alias("literal")
    )
    bytes_ = delta.replayed(stored, blocks, BLOCK).unionByName(
        docs.where(F.length("new") == 0).select(F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("place"), F.col("new").alias("data"))
    )
    files = assembled_files(bytes_.withColumn("key", F.col("key").cast("string")), new_folder(spark, "replayed"), "key", "place", "data")
    rows = written(files, "replayed-files").select(F.col("path").cast("bigint").alias("key"), "bytes", "sha256")
    return rows.join(sizes, "key", "left").select(
        F.col("key").alias("doc_id"), "bytes", "sha256", (F.coalesce("told", F.lit(0)) == F.col("bytes")).alias("complete"),
        (F.coalesce("literal", F.lit(0)) <= 3 * BLOCK + 9).alias("few_literals"),
    )


_WANTED = """q AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS request_id, 'chain-' || ['de', 'en', 'es', 'fr', 'xx'][c_custkey % 5 + 1] AS chain_v,
         c_custkey % 6 + 1 AS n, ['local', 'general', 'immutable'][c_custkey % 3 + 1] AS source, c_custkey % 11 = 0 AS bad FROM customer)"""


@query(
    f"""WITH {_HELD}, {_WANTED},
        y AS (SELECT chain_v, cycle_id, bool_and(l OR g OR i) AS local, bool_and(g OR i) AS general, bool_and(i) AS immutable FROM c GROUP BY ALL),
        p AS (SELECT chain_v, row_number() OVER w AS k, bool_and(local) OVER w AS local, bool_and(general) OVER w AS general, bool_and(immutable) OVER w AS immutable
              FROM y WINDOW w AS (PARTITION BY chain_v ORDER BY cycle_id)),
        o AS (SELECT q.request_id, any_value(bad) AS bad, count(p.k) FILTER (NOT bad) AS selected,
                count(*) FILTER (NOT bad AND CASE source WHEN 'local' THEN local WHEN 'general' THEN general ELSE immutable END) AS delivered
              FROM q LEFT JOIN p ON p.chain_v = q.chain_v AND p.k <= q.n GROUP BY q.request_id)
        SELECT request_id, CASE WHEN bad OR selected = 0 OR delivered < selected THEN 'error' ELSE 'done' END AS state,
          CASE WHEN bad THEN 'chain_below_one' WHEN selected = 0 THEN 'no_cycles' WHEN delivered < selected THEN 'not_whole' END AS reason,
          CASE WHEN selected > 0 THEN selected END AS selected, delivered,
          (SELECT count(DISTINCT d.doc_id) FROM documents d JOIN y ON y.chain_v = 'chain-' || d.lang AND y.cycle_id = d.source
           JOIN (SELECT chain_v, cycle_id, row_number() OVER (PARTITION BY chain_v ORDER BY cycle_id) AS k FROM y) z ON z.chain_v = y.chain_v AND z.cycle_id = y.cycle_id
           JOIN p ON p.chain_v = z.chain_v AND p.k = z.k
           JOIN q ON q.chain_v = z.chain_v AND z.k <= q.n AND NOT q.bad AND q.k % 10 = 0
             AND CASE q.source WHEN 'local' THEN p.local WHEN 'general' THEN p.general ELSE p.immutable END) AS files
        FROM o"""
)
def stream_restore_service(spark, root):
    """A request per customer, as documents on a stream: outcomes, and how many files stand at the destination."""
    stored, ring = _stored_artifacts(spark, root), crypto.key_ring(spark, key=DUMMY_KEY)
    k, base = F.col("c_custkey"), new_folder(spark, "service")

    def pick(values, place):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))

    body = F.to_json(F.struct(
        F.concat(F.lit("chain-"), pick(("de", "en", "es", "fr", "xx"), k % 5)).alias("version"),
        F.when(k % 11 == 0, 0).otherwise(k % 6 + 1).alias("chain"), pick(replicas.SOURCES, k % 3).alias("source"),
        (k % 10 == 0).alias("send_to_vm1"),
    ))
    table(spark, root, "customer").select(k.cast("string").alias("request_id"), body.alias("body")).write.parquet(f"{base}/requests")
    sealed = stored.groupBy(*replicas.FILE).agg(F.count(F.lit(1)).alias("n_chunks"))
    held = service.Holdings(stored.select(*replicas.CYCLE).distinct(), damaged_replicas(stored), sealed, ring)
    store = service.new_store(spark, f"{base}/store")
    stream = spark.readStream.schema("request_id string, body string").parquet(f"{base}/requests")
    service.serve(stream, store, held, f"{base}/incoming", once=True).awaitTermination()
    files = store.read("delivered").select(F.count_distinct("path")).scalar()
    return store.read("outcomes").drop("batch").withColumn("files", files)
