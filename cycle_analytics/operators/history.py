"""Membership of chunks in a chain's long history, by mergeable filters before any exact look-up.

Each batch leaves its digests, in partitions by (chain, first digits), and a blocked Bloom filter: a digest names one
block of 32,768 bits and `PROBES` bits in it. Blocks are bitmaps that Spark builds and unites with partial aggregates,
so filters of batches merge by an aggregation. A digest that misses a bit was never seen; only the others are looked up, in the
partitions their first digits name.

`blocks` bounds a chain's filter (4 kB a block, about 2,000 digests each at 16 bits). A chain that outgrows it still
gets right answers, with more look-ups; `rebuilt` makes a larger filter from the digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.session import among, written

BLOCK_BITS = 32_768
PROBES = 6
DIGESTS = "chunk_sha256 string, chain_v string, shard string, batch int"
BLOCKS = "chain_v string, block bigint, bits binary, batch int"


def number_at(digest: Column, first: int, digits: int) -> Column:
    """Some hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def block_of(digest: Column, blocks: int) -> Column:
    return number_at(digest, 50, 15) % blocks


def places_of(digest: Column) -> list[Column]:
    """The bits of a digest in its block, from digits of their own."""
    return [number_at(digest, 8 * k + 1, 8) % BLOCK_BITS for k in range(PROBES)]


def has_bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("bigint")) != 0


def filter_blocks(digests: DataFrame, blocks: int) -> DataFrame:
    """chain_v, block, bits of distinct (chain_v, chunk_sha256)."""
    digest = F.col("chunk_sha256")
    rows = digests.select("chain_v", block_of(digest, blocks).alias("block"), F.explode(F.array(*places_of(digest))).alias("place"))
    return rows.groupBy("chain_v", "block").agg(F.bitmap_construct_agg("place").alias("bits"))


@dataclass(frozen=True)
class ChunkHistory:
    """The digests and filters of all batches so far below one folder."""

    spark: SparkSession
    root: str
    blocks: int = 1024
    # How many first digits name a partition: 16, 256, ... of them a chain and batch.
    shard_digits: int = 2

    def _shard(self) -> Column:
        return F.substring("chunk_sha256", 1, self.shard_digits).alias("shard")

    def digests(self) -> DataFrame:
        return self.spark.read.schema(DIGESTS).parquet(f"{self.root}/digests")

    def filter(self) -> DataFrame:
        """The filters of all batches as one."""
        rows = self.spark.read.schema(BLOCKS).parquet(f"{self.root}/filter")
        return rows.groupBy("chain_v", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def add(self, chunks: DataFrame, batch: int) -> ChunkHistory:
        """Add a batch (chain_v, chunk_sha256); a batch that is added again replaces itself."""
        rows = chunks.select("chain_v", "chunk_sha256").distinct().select("*", self._shard())
        place = f"{self.root}/digests/batch={batch}"
        writer = rows.repartition("chain_v", "shard").write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("chain_v", "shard").parquet(place)
        kept = self.digests().where(F.col("batch") == batch)
        filter_blocks(kept, self.blocks).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.root}/filter/batch={batch}"
        )
        return self

    def rebuilt(self, root: str, blocks: int) -> ChunkHistory:
        """The same history with a filter of another size."""
        return ChunkHistory(self.spark, root, blocks, self.shard_digits).add(self.digests(), 0)

    def candidates(self, chunks: DataFrame) -> DataFrame:
        """Distinct (chain_v, chunk_sha256, shard) that the filter cannot rule out. No digest of the history is read."""
        new = chunks.select("chain_v", "chunk_sha256").distinct().withColumn("block", block_of(F.col("chunk_sha256"), self.blocks))
        met = new.join(self.filter(), ["chain_v", "block"])
        hit = F.lit(True)
        for place in places_of(F.col("chunk_sha256")):
            hit = hit & has_bit(F.col("bits"), place)
        return met.where(hit).select("chain_v", "chunk_sha256", self._shard())

    def looked_up(self, candidates: DataFrame) -> DataFrame:
        """The rows of the history in the partitions that the candidates name."""
        places = written(candidates.select("chain_v", "shard").distinct(), "history-places")
        return among(self.digests(), places, ["chain_v", "shard"])

    def known(self, chunks: DataFrame) -> DataFrame:
        """Distinct (chain_v, chunk_sha256) of the batch that the history holds."""
        maybe = written(self.candidates(chunks), "history-candidates")
        return maybe.join(self.looked_up(maybe).select("chain_v", "chunk_sha256"), ["chain_v", "chunk_sha256"], "left_semi").drop("shard")
