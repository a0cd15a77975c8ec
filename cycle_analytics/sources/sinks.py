"""Writers: telemetry, JSON lines, documents, mirrored partitions and files put together from chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.session import tasks_for
from cycle_analytics.sources.listing import BATCH_ROWS, TASK_BYTES, opened_store

WRITTEN = "path string, bytes bigint, sha256 string"


def append_csv(df: DataFrame, path: str) -> None:
    """Append telemetry rows; every file carries the header, so a reader needs no first file."""
    df.write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_documents(df: DataFrame, path: str) -> None:
    """Append one JSON document per row, keys in sorted order, absent values left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Mirror partitions: those that come along are replaced, all others stay.

    Rebalancing splits a partition value that outgrows one task and joins small ones.
    """
    (
        df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(path)
    )


def assembled_files(chunks: DataFrame, root: str, path: str = "path", order: str = "chunk_no", content: str = "chunk") -> DataFrame:
    """Files below `root` from chunk rows, each written chunk by chunk by one task: path, bytes, sha256.

    A file appears under its name when it is whole, and replaces an older one. Rows without content are empty; of
    rows that repeat a number the first counts.
    The frame must be written or counted for the files to appear; done twice it writes the same files again.
    """
    placed = chunks.select(F.col(path).alias("path"), F.col(order).alias("no"), F.col(content).alias("chunk"))
    # Many small files are few bytes, of which Spark would make a single task.
    lined = placed.repartition(tasks_for(placed, TASK_BYTES), "path").sortWithinPartitions("path", "no")
    base = root.rstrip("/")
    return lined.mapInArrow(lambda batches: put_together(batches, base), WRITTEN)


def put_together(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    """Write the files of sorted chunk rows (path, no, chunk), and tell of many in one batch: a batch costs as much as a file."""
    store, top = opened_store(base)
    now, at, file, told, size, made = None, None, None, None, 0, set()
    rows: list[tuple[str, int, str]] = []

    def finished() -> None:
        file.close()
        store.move(f"{top}/{hidden}", f"{top}/{now}")
        rows.append((now, size, told.hexdigest()))

    def batch_of_rows() -> pa.RecordBatch:
        paths, sizes, digests = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(paths), pa.array(sizes, pa.int64()), pa.array(digests)], names=["path", "bytes", "sha256"]
        )

    for batch in batches:
        for name, number, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if name == now and number == at:
                continue
            at = number
            if name != now:
                if file is not None:
                    finished()
                if len(rows) == BATCH_ROWS:
                    yield batch_of_rows()
                    rows.clear()
                folder, _, leaf = name.rpartition("/")
                if folder not in made:
                    store.create_dir(f"{top}/{folder}", recursive=True)
                    made.add(folder)
                hidden = f"{folder}/.{leaf}-{uuid.uuid4().hex}"
                now, file, told, size = name, store.open_output_stream(f"{top}/{hidden}"), sha256(), 0
            data = chunk.as_py() or b""
            file.write(data)
            told.update(data)
            size += len(data)
    if file is not None:
        finished()
    if rows:
        yield batch_of_rows()
