"""A mirror of files that changes as a whole: staged files, a manifest, and a pointer that names it.

A version is prepared first: files that differ from the published ones are written to a folder of the version, and
a manifest lists every file with its digest and where it lies. The pointer is then replaced by one rename. Readers
follow the pointer, so new and removed files change in one step; a version that is prepared and never published, or
published twice, changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.session import folder_names, make_folder
from cycle_analytics.sources.listing import file_parts, opened_store
from cycle_analytics.sources.sinks import assembled_files

MANIFEST = "path string, bytes bigint, sha256 string, place string"
POINTER = "current"


class IncompleteMirror(ValueError):
    """What was written is not what was to be written; the version cannot be published."""


@dataclass(frozen=True)
class Mirror:
    spark: SparkSession
    root: str

    def _manifest_of(self, version: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}")

    def version(self) -> str | None:
        """The published version."""
        store, path = opened_store(f"{self.root}/{POINTER}")
        try:
            with store.open_input_file(path) as file:
                return file.read().decode()
        except FileNotFoundError:
            return None

    def manifest(self) -> DataFrame:
        """path, bytes, sha256, place of the published files."""
        version = self.version()
        return self._manifest_of(version) if version else self.spark.createDataFrame([], MANIFEST)

    def prepare(self, version: str, files: DataFrame, chunks: DataFrame) -> DataFrame:
        """Stage a version: `files` has path, bytes and sha256, `chunks` the rows (path, chunk_no, chunk) of them.

        Files that are published with the same content stay where they lie and are not written.
        Returns the manifest of the version.
        """
        keys = ["path", "bytes", "sha256"]
        wanted = files.select(*keys)
        kept = wanted.join(self.manifest(), keys).select(*keys, "place")
        changed = wanted.join(kept.select("path"), "path", "left_anti")
        make_folder(self.spark, f"{self.root}/data/{version}")
        rows = assembled_files(chunks.join(changed.select("path"), "path", "left_semi"), f"{self.root}/data/{version}")
        place = f"{self.root}/staged/{version}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(place)
        staged = self.spark.read.schema(rows.schema).parquet(place)
        lost = changed.join(staged, keys, "left_anti").limit(5).collect()
        if lost:
            raise IncompleteMirror(f"not written as listed: {', '.join(row['path'] for row in lost)}")
        added = staged.select(*keys, F.concat(F.lit(f"{self.root}/data/{version}/"), "path").alias("place"))
        kept.unionByName(added).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.root}/manifests/{version}")
        return self._manifest_of(version)

    def publish(self, version: str) -> None:
        """Let readers see a prepared version."""
        if not folder_names(self.spark, f"{self.root}/manifests/{version}"):
            raise IncompleteMirror(f"version {version} is not prepared")
        store, path = opened_store(f"{self.root}/{POINTER}")
        fresh = f"{path}-{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as file:
            file.write(version.encode())
        store.move(fresh, path)

    def contents(self, part_bytes: int) -> DataFrame:
        """The published files by range: path, chunk_no, begin, chunk."""
        placed = self.manifest().select(F.col("path").alias("name"), "bytes", F.col("place").alias("path"))
        return file_parts(placed, part_bytes).select(F.col("name").alias("path"), "chunk_no", "begin", "chunk")

    def unreferenced(self, listing: DataFrame) -> DataFrame:
        """Files of a listing of the data folder that the published version does not use."""
        return listing.join(self.manifest().select(F.col("place").alias("path")), "path", "left_anti")
