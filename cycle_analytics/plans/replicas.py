"""Restore from several replicas: each chunk from the cheapest one that holds it whole, healing of the others, delivery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.functions import crypto, text
from cycle_analytics.operators import sequence
from cycle_analytics.session import written
from cycle_analytics.sources.sinks import assembled_files

CYCLE = ["chain_v", "cycle_id"]
FILE = [*CYCLE, "rel_path"]
CHUNK = [*FILE, "chunk_no"]
# The sources a request may name, the cheapest first.
SOURCES = ("local", "general", "immutable")


def judged_replicas(replicas: dict[str, DataFrame], ring: DataFrame) -> DataFrame:
    """CHUNK, replica, cost, whole for every artifact row of every replica; contents do not leave their task."""
    parts = []
    for cost, (name, artifacts) in enumerate(replicas.items()):
        opened = crypto.decrypted(artifacts, ring, "artifact", crypto.chunk_identity(*CHUNK))
        whole = F.coalesce(F.sha2("content", 256) == F.col("plain_sha256"), F.lit(False))
        parts.append(opened.select(*CHUNK, F.lit(name).alias("replica"), F.lit(cost).alias("cost"), whole.alias("whole")))
    return reduce(DataFrame.unionByName, parts)


def chosen(judged: DataFrame) -> DataFrame:
    """CHUNK and the cheapest replica that holds it whole."""
    return judged.where("whole").groupBy(*CHUNK).agg(F.min_by("replica", "cost").alias("replica"))


def due_chunks(sealed: DataFrame) -> DataFrame:
    """Every chunk that was sealed, from the files as sealed (FILE, n_chunks)."""
    files = sealed.groupBy(*FILE).agg(F.max("n_chunks").cast("int").alias("n"))
    return files.select(*FILE, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))


def healing_plan(due: DataFrame, judged: DataFrame, choice: DataFrame, names: list[str]) -> DataFrame:
    """CHUNK, target, replica: what each replica lacks and which one it comes from."""
    held = judged.where("whole").groupBy(*CHUNK).agg(F.collect_set("replica").alias("held"))
    wanted = due.join(choice, CHUNK).join(held, CHUNK, "left")
    missing = F.array_except(F.array(*[F.lit(n) for n in names]), "held")
    return wanted.select(*CHUNK, "replica", F.explode(missing).alias("target"))


def taken(replicas: dict[str, DataFrame], choice: DataFrame) -> DataFrame:
    """The artifact rows that were chosen, each replica read for its own share only."""
    shares = [
        rows.join(choice.where(F.col("replica") == name).select(*CHUNK), CHUNK, "left_semi") for name, rows in replicas.items()
    ]
    return reduce(DataFrame.unionByName, shares)


def healed_rows(replicas: dict[str, DataFrame], plan: DataFrame, target: str) -> DataFrame:
    """The rows that a replica lacks, as the others hold them."""
    return taken(replicas, plan.where(F.col("target") == target))


def allowed(replicas: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The replicas a request may use: the one it names, and what costs more when that has lost a chunk."""
    first = SOURCES.index(source)
    return {name: replicas[name] for name in SOURCES[first:] if name in replicas}


def whole_cycles(due: DataFrame, choice: DataFrame) -> DataFrame:
    """CYCLE and ok: every sealed chunk is held whole somewhere, and no path leaves its folder."""
    met = due.join(choice.withColumn("_there", F.lit(True)), CHUNK, "left")
    return met.groupBy(*CYCLE).agg(
        (F.bool_and(F.coalesce("_there", F.lit(False))) & ~F.bool_or(text.unsafe_path(F.col("rel_path")))).alias("ok")
    )


def restored(
    spark: SparkSession, plan: DataFrame, replicas: dict[str, DataFrame], sealed: DataFrame, ring: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Run a restore plan (request_id, version, cycle_id, replay_order, source, send, dest_root).

    A request takes the replicas its `source` allows. Nothing after a cycle that is not whole is restored; where
    `send` holds, the files of the others are put below its `dest_root` as chain/cycle/path. Returns the judged plan
    and what was delivered (dest_root, path, bytes, sha256). Destinations are few: each is one write.
    """
    plan = written(plan, "restore-plan")
    judged, delivered = [], []
    for source in SOURCES:
        asked = plan.where(F.col("source") == source)
        used = allowed(replicas, source)
        cycles = asked.select(F.col("version").alias("chain_v"), "cycle_id").distinct()
        near = {name: rows.join(cycles, CYCLE, "left_semi") for name, rows in used.items()}
        if not near:
            continue
        choice = written(chosen(judged_replicas(near, ring)), f"choice-{source}")
        due = due_chunks(sealed.join(cycles, CYCLE, "left_semi"))
        verdicts = whole_cycles(due, choice).select(F.col("chain_v").alias("version"), "cycle_id", "ok")
        told = asked.join(verdicts, ["version", "cycle_id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        told = written(sequence.prefix_ok(told, ["request_id"], ["replay_order"], "ok"), f"judged-{source}")
        judged.append(told)
        sent = told.where("prefix_ok AND send").select(F.col("version").alias("chain_v"), "cycle_id", "dest_root").distinct()
        for row in sent.select("dest_root").distinct().collect():
            wanted = sent.where(F.col("dest_root") == row["dest_root"]).select(*CYCLE)
            rows = taken(near, choice.join(wanted, CYCLE, "left_semi"))
            opened = crypto.decrypted(rows, ring, "artifact", crypto.chunk_identity(*CHUNK))
            files = opened.select(F.concat_ws("/", *FILE).alias("path"), "chunk_no", F.col("content").alias("chunk"))
            done = written(assembled_files(files, row["dest_root"]), "delivered")
            delivered.append(done.withColumn("dest_root", F.lit(row["dest_root"])))
    none = spark.createDataFrame([], "path string, bytes bigint, sha256 string, dest_root string")
    return reduce(DataFrame.unionByName, judged), reduce(DataFrame.unionByName, delivered, none)
