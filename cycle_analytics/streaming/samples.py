"""Windowed statistics of a sample stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.streaming.store import Store

_VALUE = "_value"


def window_stats(stream: DataFrame, ts: str, keys: list[str], value: str, minutes: int) -> DataFrame:
    """The samples with their window. They are summed batch by batch, so no sample is too late and no state is kept."""
    window = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    placed = stream.select(window.alias("_w"), *keys, F.col(value).alias(_VALUE))
    return placed.select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *keys, _VALUE)


def collect_updates(stats: DataFrame, store: Store, name: str, once: bool = True):
    """Keep count, peak and sum of every window that a batch touches."""

    def each(rows: DataFrame, batch_id: int) -> None:
        parts = rows.groupBy(*[c for c in rows.columns if c != _VALUE]).agg(
            F.count(_VALUE).alias("n"), F.max(_VALUE).alias("max_value"), F.sum(_VALUE).alias("sum_value")
        )
        store.write(parts, name, batch_id)

    writer = stats.writeStream.outputMode("append").foreachBatch(each)
    writer = writer.option("checkpointLocation", f"{store.root}/checkpoint-{name}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def current_windows(store: Store, name: str, keys: list[str]) -> DataFrame:
    """Count, peak and sum of each window over all batches."""
    return store.read(name).groupBy("bucket", *keys).agg(
        F.sum("n").alias("n"), F.max("max_value").alias("max_value"), F.sum("sum_value").alias("sum_value")
    )
