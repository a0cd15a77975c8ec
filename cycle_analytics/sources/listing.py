"""Listings of stored files as a data source, in batch and polled as a stream, and reads of byte ranges.

A listing has one row per file: path, modified, bytes. Folders are dealt to executors, which list them; contents are
never read here. As a stream every trigger is one poll, so a file that was rewritten comes with its new stamp and a
poll that finds nothing new still is a micro-batch, in which open work can be tried again. A poll's offset is the
time it was asked for, whatever number of files there is; what is new is told by a join with the files already taken.

Files are read by range (`file_parts`), so no row ever holds a file, or as one stream in order (`file_digests`), in
blocks of bounded size.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "listed_files"
LISTING = "path string, modified timestamp, bytes bigint"
FOLDER_LEVELS = 2
PART_BYTES = 4 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024
BATCH_ROWS = 4096


def opened_store(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def is_hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith((".", "_"))


def entries(store, path: str) -> Iterator[tuple[str, bool | None, int, int]]:
    """What lies in a folder: path, whether it is a folder (NULL: neither folder nor file), stamp in microseconds, size.

    A local folder is read entry by entry, so its number of files does not matter.
    """
    from pyarrow import fs

    if not isinstance(store, fs.LocalFileSystem):
        for entry in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            kind = {fs.FileType.Directory: True, fs.FileType.File: False}.get(entry.type)
            yield entry.path, kind, (entry.mtime_ns or 0) // 1000, entry.size
        return
    try:
        with os.scandir(path) as found:
            for entry in found:
                try:
                    told = entry.stat()
                except FileNotFoundError:
                    continue
                kind = True if entry.is_dir() else False if entry.is_file() else None
                yield f"{path.rstrip('/')}/{entry.name}", kind, told.st_mtime_ns // 1000, told.st_size
    except FileNotFoundError:
        return


@dataclass
class Folder(InputPartition):
    """A folder that one task lists: with all folders below it, or its own files only."""

    path: str
    deep: bool


def dealt_folders(root: str, levels: int) -> list[Folder]:
    """The folders `levels` below the root, each to be listed as a whole, and those above them."""
    store, top = opened_store(root)
    found, now = [], [top]
    for _ in range(levels):
        found += [Folder(path, False) for path in now]
        below = []
        for path in now:
            below += [name for name, is_folder, _, _ in entries(store, path) if is_folder and not is_hidden(name)]
        now = below
    return found + [Folder(path, True) for path in now]


def listed_rows(root: str, folder: Folder) -> Iterator[pa.RecordBatch]:
    """The files of a folder, as rows of the listing."""
    store, _ = opened_store(root)
    scheme = root.split("://", 1)[0] + "://" if "://" in root else ""
    todo, rows = [folder.path], []
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
    names = ["path", "modified", "bytes"]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    while todo:
        for path, is_folder, modified, size in entries(store, todo.pop()):
            if is_hidden(path):
                continue
            if is_folder:
                todo += [path] if folder.deep else []
            elif is_folder is False:
                rows.append((scheme + path, modified, size))
                if len(rows) == BATCH_ROWS:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


class ListingReader(DataSourceReader):
    def __init__(self, root: str, levels: int, deep: bool):
        self.root, self.levels, self.deep = root, levels, deep

    def partitions(self) -> list[Folder]:
        return dealt_folders(self.root, self.levels) if self.deep else [Folder(opened_store(self.root)[1], False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return listed_rows(self.root, partition)


class PolledListing(DataSourceStreamReader):
    """Every offset asked for is a new one, so every trigger lists the root again."""

    def __init__(self, root: str, levels: int):
        self.root, self.levels = root, levels

    def initialOffset(self) -> dict:
        return {"polled_at": 0}

    def latestOffset(self) -> dict:
        return {"polled_at": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return dealt_folders(self.root, self.levels)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return listed_rows(self.root, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept between polls."""


class ListedFiles(DataSource):
    """Options: path (the root), levels (how many folder levels the driver lists to deal the rest), deep (in batch; "false": the
    root's own files, listed by one task and none by the driver)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def _place(self) -> tuple[str, int]:
        return self.options["path"].rstrip("/"), int(self.options.get("levels", FOLDER_LEVELS))

    def reader(self, schema) -> ListingReader:
        return ListingReader(*self._place(), self.options.get("deep", "true") == "true")

    def streamReader(self, schema) -> PolledListing:
        return PolledListing(*self._place())


def listed(spark: SparkSession, root: str, levels: int = FOLDER_LEVELS) -> DataFrame:
    """All files below a root: path, modified, bytes. Names that begin with a dot or an underscore do not count."""
    spark.dataSource.register(ListedFiles)
    return spark.read.format(FORMAT).option("levels", levels).load(root)


def own_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that lie in a folder itself; the driver lists none of them, however many there are."""
    spark.dataSource.register(ListedFiles)
    return spark.read.format(FORMAT).option("deep", "false").load(folder)


def polled(spark: SparkSession, root: str, levels: int = FOLDER_LEVELS) -> DataFrame:
    """The same as a stream; each micro-batch is the listing of one poll."""
    spark.dataSource.register(ListedFiles)
    return spark.readStream.format(FORMAT).option("levels", levels).load(root)


def _carried(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def part_ranges(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per range of each file: chunk_no from 0, begin, size. An empty file has one empty range."""
    last = F.greatest(F.ceil(F.col("bytes") / F.lit(part_bytes)), F.lit(1)) - 1
    rows = files.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    begin = F.col("chunk_no") * part_bytes
    return rows.withColumns({"begin": begin, "size": F.least(F.lit(part_bytes), F.col("bytes") - begin)})


def reading_tasks(files: DataFrame) -> int:
    """How many tasks read the files: their rows are small, so Spark would put them all in one."""
    total = files.agg(F.sum("bytes")).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)


def file_parts(files: DataFrame, part_bytes: int = PART_BYTES, near: list[str] | None = None) -> DataFrame:
    """The columns of `files` (path and bytes among them) for each range, with chunk_no, begin and chunk.

    Ranges are dealt over the cluster before anything is read, so one large file is read by many tasks. With `near`,
    ranges that agree in these columns are read next to each other. A range that is shorter than listed (the file
    was cut since) gives what is there; a file that is gone gives no row.
    """
    ranges = part_ranges(files, part_bytes)
    carried = [c for c in ranges.columns if c != "size"]
    tasks = reading_tasks(files)
    spread = ranges.repartitionByRange(tasks, *near, "chunk_no") if near else ranges.repartition(tasks, "path", "chunk_no")
    dealt = spread.select(*carried, "size")
    return dealt.mapInArrow(lambda batches: read_ranges(batches, carried), _carried(dealt, carried) + "chunk binary")


def read_ranges(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns `carried` (path and begin among them) and what each range (with size) holds, many small ranges in one batch."""
    for batch in batches:
        rows, chunks, held = [], [], 0

        def read_so_far() -> pa.RecordBatch:
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in carried]
            return pa.RecordBatch.from_arrays([*kept, pa.array(chunks, pa.binary())], names=[*carried, "chunk"])

        wanted = [batch.column(c).to_pylist() for c in ("path", "begin", "size")]
        for row, (name, begin, size) in enumerate(zip(*wanted)):
            store, path = opened_store(name)
            try:
                with store.open_input_file(path) as file:
                    chunk = file.read_at(size, begin)
            except FileNotFoundError:
                continue
            rows.append(row)
            chunks.append(chunk)
            held += len(chunk)
            if held >= BLOCK_BYTES:
                yield read_so_far()
                rows, chunks, held = [], [], 0
        if rows:
            yield read_so_far()


def file_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of `files` with read_bytes and actual_sha256 of the whole file, read in order block by block.

    A file that is gone gives no row.
    """
    carried = list(files.columns)
    dealt = files.repartition(reading_tasks(files), "path")
    at = carried.index("path")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, digests = [], [], []
            for row, name in enumerate(batch.column(at).to_pylist()):
                store, path = opened_store(name)
                told, size = sha256(), 0
                try:
                    with store.open_input_file(path) as file:
                        while block := file.read(block_bytes):
                            told.update(block)
                            size += len(block)
                except FileNotFoundError:
                    continue
                rows.append(row)
                sizes.append(size)
                digests.append(told.hexdigest())
            taken = pa.array(rows, pa.int64())
            kept = [batch.column(k).take(taken) for k in range(len(carried))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=[*carried, "read_bytes", "actual_sha256"],
            )

    return dealt.mapInArrow(digest, _carried(dealt, carried) + "read_bytes bigint, actual_sha256 string")


def file_lines(files: DataFrame) -> DataFrame:
    """The columns of `files` with `value`, one row per text line; a list of any length is read block by block."""
    carried = list(files.columns)
    at = carried.index("path")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, name in enumerate(batch.column(at).to_pylist()):
                store, path = opened_store(name)
                for found in text_lines(store, path):
                    kept = [batch.column(k).take(pa.array([row] * len(found), pa.int64())) for k in range(len(carried))]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*carried, "value"])

    return files.mapInArrow(lines, _carried(files, carried) + "value string")


def file_texts(files: DataFrame) -> DataFrame:
    """The columns of `files` with `value`, the whole text of each; for documents, which are small. A file that is gone gives no row."""
    carried = list(files.columns)
    dealt = files.repartition(reading_tasks(files), "path")
    at = carried.index("path")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0

            def read_so_far() -> pa.RecordBatch:
                kept = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(carried))]
                return pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*carried, "value"])

            for row, name in enumerate(batch.column(at).to_pylist()):
                store, path = opened_store(name)
                try:
                    with store.open_input_stream(path, compression=None) as file:
                        text = file.read()
                except FileNotFoundError:
                    continue
                rows.append(row)
                found.append(text.decode("utf-8", "replace"))
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield read_so_far()
                    rows, found, held = [], [], 0
            yield read_so_far()

    return dealt.mapInArrow(texts, _carried(dealt, carried) + "value string")


def text_lines(store, path: str) -> Iterator[list[str]]:
    """Groups of the lines of a file; bytes that are no text are replaced."""
    held = b""
    try:
        with store.open_input_file(path) as file:
            while block := file.read(BLOCK_BYTES):
                *whole, held = (held + block).split(b"\n")
                if whole:
                    yield [line.decode("utf-8", "replace") for line in whole]
    except FileNotFoundError:
        return
    if held:
        yield [held.decode("utf-8", "replace")]


def part_list_digest(parts: DataFrame, keys: list[str], fan_out: int = 1024) -> DataFrame:
    """One digest per file over the digests of its parts in order, level by level, `fan_out` at a time.

    Parts are hashed where they were read and never meet; a node has `fan_out` children at most, so a file of any
    size is no large group. `parts` has chunk_no and chunk. Returns keys, n_parts, bytes, parts_sha256.
    """
    level = parts.select(
        *keys, F.col("chunk_no").alias("no"), F.sha2("chunk", 256).alias("digest"), F.lit(1).cast("bigint").alias("n"),
        F.length("chunk").cast("bigint").alias("size"),
    )
    # Three levels take 10^9 parts; the last one has a node per file.
    for up in (fan_out, fan_out, None):
        above = F.floor(F.col("no") / up) if up else F.lit(0)
        level = level.groupBy(*keys, above.cast("bigint").alias("up")).agg(
            ordered_digest(F.col("no"), F.col("digest")).alias("digest"), F.sum("n").alias("n"), F.sum("size").alias("size")
        ).withColumnRenamed("up", "no")
    return level.select(*keys, F.col("n").alias("n_parts"), F.col("size").alias("bytes"), F.col("digest").alias("parts_sha256"))


def ordered_digest(order: Column, digest: Column) -> Column:
    """The digest of the digests of a small group, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), digest.alias("d"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["d"]), ""), 256)
