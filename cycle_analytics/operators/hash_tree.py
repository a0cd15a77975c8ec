"""Hash trees of chains (chunk, file, cycle, chain), and the comparison of two stores by them.

A node's digest covers its children's names and digests as a set: each child is hashed to 256 bits, which are summed
in eight lanes, and the sums are hashed. Sums are partial aggregates, so a node with very many children is no hot
group and no order has to be made. A file's digest covers its chunks by number, not its own path.

Two trees are compared from the top. A level is read only below nodes that differ: its rows lie in partitions by
(chain, cycle), and the nodes that differ are written first, so Spark knows them to be few and prunes by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.session import among, written

CHAIN = ["chain_v"]
CYCLE = ["chain_v", "cycle_id"]
FILE = [*CYCLE, "rel_path"]
LANES = 8
SCHEMAS = {
    "files": "chain_v string, cycle_id string, rel_path string, digest string, n bigint, bytes bigint",
    "cycles": "chain_v string, cycle_id string, digest string, n bigint, bytes bigint",
    "chains": "chain_v string, digest string, n bigint, bytes bigint",
}
PARTS = {"files": CYCLE, "cycles": CHAIN, "chains": []}


def set_digest(name: Column, digest: Column) -> Column:
    """Aggregate: the digest of a set of named children."""
    child = F.sha2(F.concat(F.char_length(name).cast("string"), F.lit(":"), name, digest), 256)
    lanes = [
        F.sum(F.conv(F.substring(child, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(LANES)
    ]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *lanes), 256)


def file_nodes(chunks: DataFrame) -> DataFrame:
    """Files from chunk rows (FILE, chunk_no, chunk_sha256, bytes)."""
    return chunks.groupBy(*FILE).agg(
        set_digest(F.col("chunk_no").cast("string"), F.col("chunk_sha256")).alias("digest"),
        F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("bigint").alias("bytes"),
    )


def nodes_above(nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The next level up: nodes by `keys` over children named by column `name`."""
    return nodes.groupBy(*keys).agg(
        set_digest(F.col(name), F.col("digest")).alias("digest"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )


@dataclass(frozen=True)
class HashTree:
    """The stored levels of a tree below one folder."""

    spark: SparkSession
    root: str

    def level(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _write(self, name: str, nodes: DataFrame) -> None:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        writer = nodes.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer = writer.partitionBy(*PARTS[name]) if PARTS[name] else writer.option("partitionOverwriteMode", "static")
        writer.parquet(f"{self.root}/{name}")

    def add(self, chunks: DataFrame) -> HashTree:
        """Add cycles, or replace them; the levels above are made anew from the level below them, never from chunks."""
        self._write("files", file_nodes(chunks).hint("rebalance", *CYCLE))
        chains = written(chunks.select(*CHAIN).distinct(), "tree-touched")
        self._write("cycles", nodes_above(among(self.level("files"), chains, CHAIN), CYCLE, "rel_path"))
        self._write("chains", nodes_above(self.level("cycles"), CHAIN, "cycle_id"))
        return self


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes whose digests differ, with both sides' digest and bytes; the side that lacks a node has NULLs."""
    def side(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.select(*keys, F.col("digest").alias(f"{name}_digest"), F.col("bytes").alias(f"{name}_bytes"))

    met = side(left, "left").join(side(right, "right"), keys, "full")
    return met.where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def differing_files(left: HashTree, right: HashTree) -> DataFrame:
    """Files that are not equal in both trees, found from the roots down."""
    chains = written(differing(left.level("chains"), right.level("chains"), CHAIN).select(*CHAIN), "tree-chains")
    cycles = written(
        differing(*[among(t.level("cycles"), chains, CHAIN) for t in (left, right)], CYCLE).select(*CYCLE), "tree-cycles"
    )
    return differing(*[among(t.level("files"), cycles, CYCLE) for t in (left, right)], FILE)


def compared(left: HashTree, right: HashTree) -> DataFrame:
    """FILE, status, other_path, left_bytes, right_bytes of every file that is not equal in both.

    status is altered, lost (left only), extra (right only) or renamed: the one lost file of a chain with this content
    came back as its one extra file. A renamed file stands under its old path, with the new one as `other_path`
    (cycle/path); the extra row goes. Where several files share a content, what was renamed to what is unknown.
    """
    found = written(differing_files(left, right), "tree-files")
    lost, extra = F.col("right_digest").isNull(), F.col("left_digest").isNull()
    single = found.where(lost | extra).groupBy("chain_v", F.coalesce("left_digest", "right_digest").alias("digest")).agg(
        F.count_if(lost).alias("n_lost"), F.count_if(extra).alias("n_extra"),
        F.max(F.when(extra, F.concat("cycle_id", F.lit("/"), "rel_path"))).alias("other_path"),
    ).where("n_lost = 1 AND n_extra = 1").select("chain_v", "digest", F.col("other_path").alias("moved_to"))
    told = found.withColumn("digest", F.when(lost | extra, F.coalesce("left_digest", "right_digest")))
    met = told.join(single, ["chain_v", "digest"], "left")
    status = (
        F.when(lost & F.col("moved_to").isNotNull(), "renamed").when(lost, "lost")
        .when(extra & F.col("moved_to").isNotNull(), None).when(extra, "extra").otherwise("altered")
    )
    judged = met.select(*FILE, status.alias("status"), F.when(lost, F.col("moved_to")).alias("other_path"), "left_bytes", "right_bytes")
    return judged.where("status IS NOT NULL")
