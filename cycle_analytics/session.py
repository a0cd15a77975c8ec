"""Session settings, the shared work folder and plan-size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame that reads less than this fits in one task without trouble.
SMALL_PLAN_BYTES = 64 * 1024 * 1024

# The optimizer reports sizes near the largest long where it knows nothing.
UNKNOWN_BYTES = 2**50

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_local_roots: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    """Start a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_wall_clock(spark: SparkSession) -> None:
    """Pin the session zone so that zone-free stamps and instants convert without shifts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A private folder is made only in local mode and only where none is named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_roots[app] = tempfile.mkdtemp(prefix="cycle-analytics-")
    return _local_roots[app]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; the writer creates it, and `clear_work` removes it."""
    path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Remove the folders this session made, once their frames were consumed; returns how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder on whatever file system the path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where the folder is absent."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(place)] if system.exists(place) else []


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, and gives two readers of one frame the same rows even when
    an executor is lost between them.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among those of `few`, reading only their partitions where the keys name some.

    The condition on `few` always holds. Without one Spark does not expect the join to select, and would read every
    partition; `few` should be a written frame, so that its size is known.
    """
    return rows.join(few.select(*keys).where(F.length(F.col(keys[0])) >= 0), keys, "left_semi")


def input_bytes(df: DataFrame) -> int:
    """Size of everything a frame reads.

    Unlike the estimate of the whole plan, which multiplies the two sides of a join.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def tasks_for(df: DataFrame, task_bytes: int) -> int:
    """Tasks for the rows of a frame, by what it reads: the estimate of a plan multiplies the sides of each join."""
    tasks, estimate = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return max(tasks, -(-estimate // task_bytes)) if estimate < UNKNOWN_BYTES else tasks


def is_small(df: DataFrame, limit: int = SMALL_PLAN_BYTES) -> bool:
    """Whether the inputs of a frame are so small that any of its groups fits in one task."""
    return input_bytes(df) <= limit
