"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What `[^\x20\x09-\x0D]+` leaves out: the blanks between words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
GROUP_BYTES = 256 * 1024


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra columns of the caller never clash with new ones."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def slices(batch: pa.RecordBatch, column: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that the values of one column stay below `limit` bytes a piece (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    if first < batch.num_rows:
        yield batch.slice(first)


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task otherwise keeps its largest batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

# What operators remember between tasks of a worker: name of the operator, and what drops it.
_remembered: dict[str, Callable[[], object]] = {}


def remembers(owner: str, drop: Callable[[], object]) -> None:
    """Register what an operator keeps in a worker from task to task."""
    _remembered[owner] = drop


def forget_others(owner: str | None) -> None:
    """Drop what other operators keep; a worker runs task after task of one operator, then those of the next."""
    for name, drop in _remembered.items():
        if name != owner:
            drop()


def freed(work: Work, owner: str | None = None) -> Work:
    """A task's function over Arrow batches that gives its memory back at the end.

    It starts without what operators other than `owner` remember.
    """

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def freed_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function over a group; it gives memory back after groups of some size."""

    def run(group: pa.Table) -> pa.Table:
        done = work(group)
        if group.nbytes >= GROUP_BYTES:
            give_back()
        return done

    return run
