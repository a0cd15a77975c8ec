"""Batch-keyed tables: a repeated micro-batch replaces its own rows and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.session import folder_names, make_folder


class Store:
    """Named parquet tables below one root, one folder per micro-batch.

    `parts` names columns that divide a table's batches further, so that a join on them reads its partitions only.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], parts: dict[str, list[str]] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = schemas
        self.parts = parts or {}

    def create(self) -> Store:
        """Make the folder of every table, so that it can be read before its first batch."""
        for name in self.schemas:
            make_folder(self.spark, self.path(name))
        return self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, batch_id: int) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        if name in self.parts:
            writer = writer.partitionBy(*self.parts[name])
        writer.parquet(f"{self.path(name)}/batch={batch_id}")

    def staged(self, df: DataFrame, purpose: str, batch_id: int) -> DataFrame:
        """Rows that a batch reads more than once: written beside the tables, replaced when the batch is repeated."""
        path = f"{self.path('_work')}/{purpose}/batch={batch_id}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def newest(self, name: str, before: int) -> int | None:
        """The last batch of a table before the given one."""
        numbers = [int(f.removeprefix("batch=")) for f in folder_names(self.spark, self.path(name)) if f.startswith("batch=")]
        return max((n for n in numbers if n < before), default=None)

    def read(self, name: str) -> DataFrame:
        """All rows of a table with their `batch` number."""
        return self.spark.read.schema(f"{self.schemas[name]}, batch int").parquet(self.path(name))

    def before(self, name: str, batch_id: int) -> DataFrame:
        """Rows of earlier batches; folders of other batches are pruned."""
        return self.read(name).where(F.col("batch") < batch_id).drop("batch")

    def upto(self, name: str, batch_id: int) -> DataFrame:
        return self.read(name).where(F.col("batch") <= batch_id).drop("batch")

    def only(self, name: str, batch_id: int) -> DataFrame:
        return self.read(name).where(F.col("batch") == batch_id).drop("batch")
