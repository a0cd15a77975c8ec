"""Checksum lists, readiness of packages, reconciliation and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Files every package must have.
CHECKSUM_FILE = "checksums.sha256"
MANIFEST_FILE = "manifest.json"

PACKAGE = ["chain_v", "cycle_id"]
FILE = [*PACKAGE, "rel_path"]


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def checksum_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Split list lines into digest and path; blank and `#` lines do not count."""
    line = F.trim(F.regexp_replace(F.col(text), r"[\t\r]", " "))
    parts = F.split(line, r"\s+", 2)
    return (
        lines.withColumn("_parts", parts)
        .where((line != "") & ~line.startswith("#") & (F.size("_parts") == 2))
        .withColumn("expected_sha256", F.col("_parts")[0])
        .withColumn("rel_path", F.ltrim(F.col("_parts")[1], F.lit("* ")))
        .drop("_parts", text)
    )


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare listed digests with present files: status ok, altered or missing.

    Files that are not listed do not matter, and a list may name itself without
    being present. Only digests are shuffled.
    """
    joined = expected.join(actual.select(*FILE, "actual_sha256"), FILE, "left")
    status = (
        F.when(F.col("actual_sha256") == F.col("expected_sha256"), "ok")
        .when(F.col("actual_sha256").isNotNull(), "altered")
        .when(F.col("rel_path") == CHECKSUM_FILE, "skipped")
        .otherwise("missing")
    )
    return joined.withColumn("status", status)


def package_report(checked: DataFrame) -> DataFrame:
    """Files ok and failed per package."""
    failed = F.col("status").isin("altered", "missing")
    return checked.groupBy(*PACKAGE).agg(
        F.count_if(F.col("status") == "ok").alias("files_ok"),
        F.count_if(failed).alias("files_failed"),
    )


def readiness(inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """A package is ready when manifest and list are present and every digest holds.

    `inventory` has chain_v, cycle_id, rel_path and actual_sha256.
    """
    present = inventory.groupBy(*PACKAGE).agg(
        (F.count_if(F.col("rel_path") == MANIFEST_FILE) > 0).alias("has_manifest"),
        (F.count_if(F.col("rel_path") == CHECKSUM_FILE) > 0).alias("has_list"),
    )
    report = package_report(verified(expected, inventory))
    none = F.lit(0)
    return present.join(report, PACKAGE, "left").select(
        *PACKAGE, "has_manifest", "has_list",
        F.coalesce("files_ok", none).alias("files_ok"),
        F.coalesce("files_failed", none).alias("files_failed"),
        (
            F.col("has_manifest") & F.col("has_list")
            & (F.coalesce("files_failed", none) == 0) & (F.coalesce("files_ok", none) > 0)
        ).alias("ready"),
    )


def failure_tail(failures: DataFrame, keys: list[str], order: str, line: str, keep: int = 5) -> DataFrame:
    """The last non-blank failure lines per group, joined by ` | `.

    The row limit is pushed below the shuffle, so a large group sends `keep` rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = failures.where(F.trim(line) != "").withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return last.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), " | ").alias("tail"))


def unsafe_packages(files: DataFrame, unsafe: Column, keys: list[str] | None = None) -> DataFrame:
    """One unsafe member rejects its whole package."""
    return files.groupBy(*(keys or PACKAGE)).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(unsafe).alias("unsafe_members"), F.bool_or(unsafe).alias("rejected")
    )


def reconciled(artifacts: DataFrame, catalog: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Which of artifact, catalog row and done marker each key has."""
    keys = keys or PACKAGE
    named = {"has_artifact": artifacts, "has_catalog": catalog, "has_done": done}
    flags = flagged(named, keys)
    return flags.withColumn("consistent", F.col("has_artifact") & F.col("has_catalog") & F.col("has_done"))


def flagged(named: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per key with a flag for each frame that has it.

    One union and one aggregation instead of a join per frame, so a key with very many
    rows shrinks before the only shuffle.
    """
    parts = [
        df.select(*keys, *[F.lit(name == own).alias(name) for name in named]) for own, df in named.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.bool_or(name).alias(name) for name in named])


def offenders(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows where a recorded total differs from its recomputed value, one row per finding."""
    findings = F.array(
        *[
            F.when(
                ~recorded.eqNullSafe(computed),
                F.struct(
                    F.lit(name).alias("check"),
                    recorded.cast("double").alias("recorded"),
                    computed.cast("double").alias("computed"),
                ),
            )
            for name, (recorded, computed) in checks.items()
        ]
    )
    kept = [c for c in df.columns if c not in ("check", "recorded", "computed")]
    return df.withColumn("_f", F.explode(F.filter(findings, lambda x: x.isNotNull()))).select(
        *kept, "_f.check", "_f.recorded", "_f.computed"
    )


def audit_counts(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Number of offending rows per check."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~recorded.eqNullSafe(computed)).alias(name) for name, (recorded, computed) in checks.items()],
    )
