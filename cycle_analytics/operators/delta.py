"""Deltas between two versions of files: what can be copied from the old one, and the bytes that cannot.

The old version is cut into blocks of a fixed size, the new one is looked at from every byte on, so an inserted byte
moves what follows without changing it.

1. Old blocks get a weak checksum, which can be rolled over bytes, and a 128-bit digest.
2. The weak checksums of a file become a bit filter (two bytes a block), built by Spark's bitmap aggregates. Parts of
   the new version take the filter of their file, roll the checksum over all places with prefix sums and keep the few
   places that the filter lets through, with the digest of the block that begins there.
3. Places meet old blocks by an equi-join on the digest. That is the proof; the filter only saves rows.
4. Matches pass once in order per file, as a stream: one that overlaps the last copy is left out, copies that
   continue each other are joined, gaps are literals.

Files are given in chunk rows: old ones in blocks, new ones in parts that reach `block - 1` bytes into the next part.
Stretches that repeat (zeros, say) hold a block at every period; its places at equal steps are one row, so a part names as many
rows as the period has bytes, and every place counts. The old file's last, shorter block is literal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
PART = 1024 * 1024
FILTER_BITS = 32_768
BLOCKS_A_FILTER = 2048
STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SHIFT = np.uint64(33)


def old_blocks(files: DataFrame, key: str, content: str, block: int = BLOCK) -> DataFrame:
    """key, block_no, data of whole blocks, from rows that hold a file or, with `begin`, a range of whole blocks."""
    begin = F.col("begin") if "begin" in files.columns else F.lit(0).cast("bigint")
    n = F.floor(F.length(content) / F.lit(block)).cast("int")
    rows = files.where(F.length(content) >= block).select(
        F.col(key).alias("key"), begin.alias("begin"), F.col(content).alias("content"), F.explode(F.sequence(F.lit(0), n - 1)).alias("no")
    )
    return rows.select(
        "key", (F.floor(F.col("begin") / block) + F.col("no")).cast("bigint").alias("block_no"),
        F.substring("content", F.col("no") * block + 1, F.lit(block)).alias("data"),
    )


def new_parts(files: DataFrame, key: str, content: str, block: int = BLOCK, part: int = PART) -> DataFrame:
    """key, begin, size (bytes that are the part's own), data (reaching into the next part)."""
    n = F.greatest(F.ceil(F.length(content) / F.lit(part)), F.lit(1)).cast("int")
    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content"), F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
    begin = F.col("no") * part
    return rows.select(
        "key", begin.cast("bigint").alias("begin"), F.least(F.lit(part), F.length("content") - begin).cast("bigint").alias("size"),
        F.substring("content", begin + 1, F.lit(part + block - 1)).alias("data"),
    )


def rolled(data: bytes, block: int) -> np.ndarray:
    """The weak checksum of the block that begins at each place."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(x) < block:
        return np.zeros(0, np.uint64)
    plain = np.concatenate([[np.uint64(0)], np.cumsum(x)])
    by_place = np.concatenate([[np.uint64(0)], np.cumsum(x * np.arange(len(x), dtype=np.uint64))])
    n = len(x) - block + 1
    total = plain[block:] - plain[:n]
    weighed = (np.arange(n, dtype=np.uint64) + np.uint64(block)) * total - (by_place[block:] - by_place[:n])
    return (total & np.uint64(0xFFFF)) | ((weighed & np.uint64(0xFFFFFFFF)) << np.uint64(16))


def bits_of(weak: np.ndarray) -> list[np.ndarray]:
    """Numbers below 2^31 that name a checksum's bits, modulo the size of a filter."""
    return [((weak * step) >> SHIFT).astype(np.int64) for step in STEPS]


def strong(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def signatures(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, block_no, strong, and the filter bits of each old block."""
    kind = blocks.schema["key"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            weak = np.array([rolled(d, block)[0] for d in data], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([strong(d) for d in data], pa.binary()), *map(pa.array, bits_of(weak))],
                names=["key", "block_no", "strong", "m0", "m1", "m2"],
            )

    return blocks.select("key", "block_no", "data").mapInArrow(sign, f"key {kind}, block_no bigint, strong binary, m0 bigint, m1 bigint, m2 bigint")


def file_filters(signed: DataFrame) -> DataFrame:
    """key, groups, bits: a filter per file, as the bitmaps of its groups in order of their number."""
    sizes = signed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_A_FILTER).cast("bigint").alias("groups"))
    places = signed.select("key", F.explode(F.array("m0", "m1", "m2")).alias("m")).join(sizes, "key").select(
        "key", "groups", (F.col("m") % (F.col("groups") * FILTER_BITS)).alias("bit")
    )
    maps = places.groupBy("key", "groups", F.floor(F.col("bit") / FILTER_BITS).alias("part")).agg(
        F.bitmap_construct_agg(F.col("bit") % FILTER_BITS).alias("bits")
    )
    return maps.groupBy("key", "groups").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("bits"))


def likely_places(parts: DataFrame, filters: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, place, until, step, strong of the blocks of the new version that the filter of their file lets through.

    A row names the places from `place` to `until`, `step` apart, that hold the same block.
    """
    met = parts.join(filters, "key").select("key", "begin", "size", "data", "groups", "bits")
    kind = met.schema["key"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                begin, size, data, groups, maps = (batch.column(k)[row].as_py() for k in range(1, 6))
                held = np.zeros((groups, FILTER_BITS // 8), np.uint8)
                for one in maps:
                    held[one["part"]] = np.frombuffer(one["bits"], np.uint8)
                flat = held.ravel()
                weak = rolled(data, block)[:size]
                open_ = np.ones(len(weak), bool)
                for bit in bits_of(weak):
                    bit %= groups * FILTER_BITS
                    open_ &= (flat[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                runs, last = [], {}
                for at in np.flatnonzero(open_).tolist():
                    digest = strong(data[at : at + block])
                    run = last.get(digest)
                    if run and at - run[1] < block and run[2] in (0, at - run[1]):
                        run[1:3] = at, at - run[1]
                    else:
                        last[digest] = run = [at, at, 0, digest]
                        runs.append(run)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row] * len(runs), pa.int64())), pa.array([begin + r[0] for r in runs], pa.int64()),
                        pa.array([begin + r[1] for r in runs], pa.int64()), pa.array([r[2] for r in runs], pa.int64()),
                        pa.array([r[3] for r in runs], pa.binary()),
                    ],
                    names=["key", "place", "until", "step", "strong"],
                )

    return met.mapInArrow(look, f"key {kind}, place bigint, until bigint, step bigint, strong binary")


def instructions(blocks: DataFrame, parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, place, length, source: copies from `source` in the old version, literals where it is NULL. In order they give the new version."""
    signed = signatures(blocks, block)
    proof = signed.groupBy("key", "strong").agg(F.min("block_no").alias("block_no"))
    matches = likely_places(parts, file_filters(signed), block).join(proof, ["key", "strong"]).select("key", "place", "block_no", "until", "step")
    none = F.lit(None).cast("bigint")
    ends = parts.groupBy("key").agg(F.max(F.col("begin") + F.col("size")).alias("place")).select(
        "key", "place", none.alias("block_no"), none.alias("until"), none.alias("step")
    )
    # A file's last row is its end, so that every file passes.
    lined = matches.unionByName(ends).repartition("key").sortWithinPartitions("key", "place", F.col("block_no").asc_nulls_last())
    kind = lined.schema["key"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The end of what is told, the open copy (place, length, source), and the rows that name places beyond that end.
        at, copy, named = 0, None, []
        rows, out = [], []

        def tell(row: int, place: int, length: int, source: int | None) -> None:
            if length:
                rows.append(row)
                out.append((place, length, source))

        def take(row: int, place: int, number: int) -> None:
            nonlocal at, copy
            if copy and (place > at or number * block != copy[2] + copy[1]):
                tell(row, *copy)
                copy = None
            if place > at:
                tell(row, at, place - at, None)
            copy = (copy[0], copy[1] + block, copy[2]) if copy else (place, block, number * block)
            at = place + block

        def pass_to(row: int, end: int) -> None:
            """Take matches in order up to a place from where rows are yet to come."""
            while named:
                ahead = []
                for number, place, until, step in named:
                    if place < at and step:
                        place += -(-(at - place) // step) * step
                    if at <= place <= until:
                        ahead.append((number, place, until, step))
                named[:] = ahead
                number, place = min(((n, p) for n, p, *_ in ahead), key=lambda x: x[1], default=(0, end))
                if place >= end:
                    return
                take(row, place, number)

        for batch in batches:
            rows, out = [], []
            for row, (place, number, until, step) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)))):
                pass_to(row, place)
                if number is not None:
                    named.append((number, place, until, step))
                    continue
                if copy:
                    tell(row, *copy)
                tell(row, at, place - at, None)
                at, copy = 0, None
                named.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))],
                names=["key", "place", "length", "source"],
            )

    return lined.mapInArrow(choose, f"key {kind}, place bigint, length bigint, source bigint")


def with_literals(told: DataFrame, parts: DataFrame, part: int = PART) -> DataFrame:
    """The delta as it is stored: instructions, literals cut at part borders and with their bytes."""
    first, last = F.floor(F.col("place") / part), F.floor((F.col("place") + F.col("length") - 1) / part)
    cut = told.where("source IS NULL").withColumn("no", F.explode(F.sequence(first, last))).select(
        "key", (F.col("no") * part).alias("begin"), F.greatest("place", F.col("no") * part).alias("place"),
        F.least(F.col("place") + F.col("length"), (F.col("no") + 1) * part).alias("end"),
    )
    bytes_ = F.substring("data", (F.col("place") - F.col("begin") + 1).cast("int"), (F.col("end") - F.col("place")).cast("int"))
    literal = cut.join(parts.select("key", "begin", "data"), ["key", "begin"]).select(
        "key", "place", (F.col("end") - F.col("place")).alias("length"), F.lit(None).cast("bigint").alias("source"), bytes_.alias("data")
    )
    return literal.unionByName(told.where("source IS NOT NULL").withColumn("data", F.lit(None).cast("binary")))


def replayed(delta: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, place, data of the new version, from the old blocks and the delta alone."""
    copies = delta.where("source IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("length") / block).cast("int") - 1)))
    wanted = copies.select("key", (F.col("place") + F.col("k") * block).alias("place"), (F.col("source") / block + F.col("k")).cast("bigint").alias("block_no"))
    copied = wanted.join(blocks, ["key", "block_no"]).select("key", "place", "data")
    return copied.unionByName(delta.where("source IS NULL").select("key", "place", "data"))
