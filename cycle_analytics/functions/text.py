"""Display forms for copy tables and path checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value.cast("double"))


def unsafe_path(path: Column) -> Column:
    """Absolute paths and any `..` segment are unsafe."""
    return path.startswith("/") | path.startswith("\\") | F.array_contains(F.split(path, "/"), "..")


def cycle_from_name(name: Column) -> Column:
    """Cycle id from an artifact or metadata file name."""
    return F.regexp_replace(name, r"\.tar\.aes256gcm(\.meta\.json)?$", "")


def artifact_name(cycle_id: Column) -> Column:
    return F.concat(cycle_id, F.lit(".tar.aes256gcm"))


def metadata_name(cycle_id: Column) -> Column:
    return F.concat(cycle_id, F.lit(".tar.aes256gcm.meta.json"))


def fill_placeholders(template: str, src: Column, cycle_id: Column, chain_v: Column) -> Column:
    """Target URI of a template with the places {src}, {cycle_id} and {chain_v}."""
    filled = F.lit(template)
    for place, value in (("{src}", src), ("{cycle_id}", cycle_id), ("{chain_v}", chain_v)):
        filled = F.replace(filled, F.lit(place), value)
    return filled
