"""Restore requests and cycle manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SOURCES = ["local", "general", "immutable"]
FALSE_WORDS = ["0", "false", "no", "off", ""]
COMPONENTS = ["pg_basebackup", "mongo_basebackup", "unstructured_basebackup", "mongo", "pfc", "files", "fixtures"]

_INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def loose_boolean(value: Column, kind: Column) -> Column:
    """Booleans as they are, numbers by their whole part, words unless they mean no; absent is true."""
    number = value.try_cast("double").try_cast("bigint")
    return (
        F.when(kind.isNull(), True)
        .when(kind == "BOOLEAN", value == "true")
        .when(_is_number(kind), number != 0)
        .when(kind == "VOID", True)
        .otherwise(~F.lower(F.trim(value)).isin(FALSE_WORDS))
    )


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")


def _evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters cannot inline, so a costly value is computed once per row."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def parsed_requests(df: DataFrame, body: str, default_dest: str, cloud_alias: bool = False) -> DataFrame:
    """Validate request documents in a JSON text column.

    Adds version, chain_n, source, send, dest_root and error_reason (NULL when valid).
    `cloud_alias` reads the source name `cloud` as `general`. The document is parsed once;
    each step below reads the columns of the step before.
    """
    fields = ["version", "chain_v", "chain", "source", "send_to_vm1", "vm1_dest_root"]
    doc = _evaluated(df, {"_doc": F.try_parse_json(F.col(body))})
    parts = {f: F.try_variant_get(F.col("_doc"), f"$.{f}", "variant") for f in fields}
    typed = {f"_k_{f}": F.schema_of_variant(v) for f, v in parts.items()}
    texts = {f"_t_{f}": F.try_variant_get(F.col("_doc"), f"$.{f}", "string") for f in fields}
    read = _evaluated(doc, {**typed, **texts, "_broken": F.col("_doc").isNull()})

    def kind(field: str) -> Column:
        return F.col(f"_k_{field}")

    def text(field: str) -> Column:
        return F.col(f"_t_{field}")

    falsy = (
        kind("version").isNull() | (kind("version") == "VOID")
        | ((kind("version") == "STRING") & (text("version") == ""))
        | ((kind("version") == "BOOLEAN") & (text("version") == "false"))
        | (_is_number(kind("version")) & (text("version").try_cast("double") == 0))
    )
    chain_kind, chain_text = kind("chain"), text("chain")
    chain_n = (
        F.when(chain_kind == "BOOLEAN", (chain_text == "true").cast("bigint"))
        .when(_is_number(chain_kind), chain_text.try_cast("double").try_cast("bigint"))
        .when(
            (chain_kind == "STRING") & chain_text.rlike(_INTEGER),
            F.replace(F.trim(chain_text), F.lit("_"), F.lit("")).try_cast("bigint"),
        )
    )
    source = F.when(kind("source").isNull(), F.lit("local")).otherwise(text("source"))
    if cloud_alias:
        source = F.when(text("source") == "cloud", "general").otherwise(source)
    source_text = kind("source").isNull() | (kind("source") == "STRING")
    dest_ok = (kind("vm1_dest_root") == "STRING") & (F.trim(text("vm1_dest_root")) != "")
    derived = read.withColumns(
        {
            "_name": F.when(falsy, text("chain_v")).otherwise(text("version")),
            "_name_kind": F.when(falsy, kind("chain_v")).otherwise(kind("version")),
            "chain_n": chain_n,
            "source": source,
            "_source_text": source_text,
            "send": loose_boolean(text("send_to_vm1"), kind("send_to_vm1")),
            "dest_root": F.when(dest_ok, F.trim(text("vm1_dest_root"))).otherwise(F.lit(default_dest)),
        }
    )
    name = F.when((F.col("_name_kind") == "STRING") & (F.trim("_name") != ""), F.trim("_name"))
    named = derived.withColumn("version", name)
    reason = (
        F.when(F.col("_broken"), "parse_error")
        .when(F.col("version").isNull(), "missing_version")
        .when(chain_kind.isNull() | (chain_kind == "VOID"), "missing_chain")
        .when(F.col("chain_n").isNull(), "chain_not_integer")
        .when(F.col("chain_n") < 1, "chain_below_one")
        .when(~F.coalesce(F.col("_source_text") & F.col("source").isin(SOURCES), F.lit(False)), "invalid_source")
    )
    out = named.withColumn("error_reason", reason)
    return out.select(*df.columns, "error_reason", "version", "chain_n", "source", "send", "dest_root")


def map_total(sizes: Column) -> Column:
    """Sum of the values of a map."""
    return F.aggregate(F.map_values(sizes), F.lit(0).cast("bigint"), lambda total, size: total + F.coalesce(size, F.lit(0)))


def manifest_summary(
    scalars: dict[str, Column], present: dict[str, Column], pfc_sizes: Column, file_sizes: Column
) -> Column:
    """Kept scalars, present components in their fixed order and the scanned bytes.

    An empty size map counts as absent; `files` is used when `pfc` has none.
    """
    components = F.filter(
        F.array(*[F.when(present[name], F.lit(name)) for name in COMPONENTS if name in present]),
        lambda name: name.isNotNull(),
    )
    has_pfc = F.coalesce(F.size(pfc_sizes) > 0, F.lit(False))
    sizes = F.when(has_pfc, pfc_sizes).otherwise(file_sizes)
    scanned = F.when(F.coalesce(F.size(sizes) > 0, F.lit(False)), map_total(sizes))
    return F.struct(
        *[value.alias(name) for name, value in scalars.items()],
        F.when(F.size(components) > 0, components).alias("components"),
        scanned.alias("unstructured_raw_bytes"),
    )
