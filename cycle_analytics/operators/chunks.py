"""Fixed-size chunks, dedup against the chain so far, and their re-assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(files: DataFrame, content: str, size: int) -> DataFrame:
    """One row per chunk of `size` units, numbered from 0; an empty file has one empty chunk."""
    pieces = F.greatest(F.ceil(F.length(content) / F.lit(size)), F.lit(1)).cast("int")
    rows = files.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return rows.withColumn("chunk", F.substring(F.col(content), F.col("chunk_no") * size + 1, F.lit(size))).drop(content)


def with_digest(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_sha256", F.sha2(F.col("chunk").cast("binary"), 256))


def first_stored(chunks: DataFrame, keys: list[str], order: list[str], digest: str = "chunk_sha256") -> DataFrame:
    """For each distinct chunk of a chain the place that stores it; later copies only refer to it.

    A minimum with partial aggregation, so a chunk that repeats everywhere is no hot group.
    """
    return chunks.groupBy(*keys, digest).agg(
        F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("copies")
    )


def new_chunks(chunks: DataFrame, earlier: DataFrame, keys: list[str], digest: str = "chunk_sha256") -> DataFrame:
    """Chunks whose digest no earlier cycle of the chain has."""
    return chunks.join(earlier.select(*keys, digest).distinct(), [*keys, digest], "left_anti")


def latest_chunks(chunks: DataFrame, place: list[str], version: str, payload: list[str]) -> DataFrame:
    """The newest version of each chunk place, for replay on restore."""
    newest = F.max_by(F.struct(*payload), version).alias("_row")
    return chunks.groupBy(*place).agg(newest).select(*place, "_row.*")


def verified_counts(applied: DataFrame, keys: list[str], expected: str, actual: str) -> DataFrame:
    """Chunks applied, verified and failed per group."""
    same = F.coalesce(F.col(expected) == F.col(actual), F.lit(False))
    return applied.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("applied_chunks"),
        F.count_if(same).alias("verified_ok_chunks"),
        F.count_if(~same).alias("verified_fail_chunks"),
    )
