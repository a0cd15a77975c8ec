"""Monitoring charts with any header: columns are bound by name, no schema is needed and one scan reads all files.

Every line is read as data. A line whose first cell is `timestamp` is its file's header; its cells become (position,
name, unit) and meet the cells of the file's other lines by file. So files with other columns, another order, padding
or repeated names come out in one long form: file, host, chart, dim, unit, ts, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.functions.clock import local_from_millis, on_date
from cycle_analytics.sources.telemetry import MISSING

# Cells that hold no measure.
STAMP = "timestamp"
NOT_MEASURES = ("anomaly%", "annotations")
# A comma outside quotes; the name of a column, then its unit in the last brackets.
COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
NAME = r"^(.*?)\s*(?:\s\(([^()]*)\))?$"


def cells(line: Column) -> Column:
    """The cells of a line, without padding and quotes."""
    return F.transform(F.split(line, COMMA), lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"[\r\t]", " ")), '^"(.*)"$', "$1"))


def header_columns(named: Column) -> Column:
    """(position, dim, unit) of the measures of a header. A name that repeats is numbered from its second place on."""
    def column(name: Column, position: Column) -> Column:
        dim = F.regexp_extract(name, NAME, 1)
        again = F.size(F.filter(F.slice(named, F.lit(1), position + 1), lambda n: n == name))
        told = F.when(again > 1, F.concat(dim, F.lit("_"), again.cast("string"))).otherwise(dim)
        return F.struct(position.alias("position"), told.alias("dim"), F.nullif(F.regexp_extract(name, NAME, 2), F.lit("")).alias("unit"), name.alias("name"))

    measures = F.filter(F.transform(named, column), lambda c: (c["position"] > 0) & (c["name"] != "") & ~F.lower(c["name"]).isin(*NOT_MEASURES))
    return F.transform(measures, lambda c: c.dropFields("name"))


def chart_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and cells of every line that is not blank."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), cells(F.col("value")).alias("cells"))


def metric_charts(spark: SparkSession, path: str | list[str], run_date: str, null_policy: str = "drop") -> DataFrame:
    """All charts below a path in long form. Stamps are times of day of `run_date`, or epoch milliseconds.

    `drop` leaves cells without a number out, `zero` fills them. A file without a header has no rows; lines shorter
    than their header have missing cells. Host and chart come from the file's name.
    """
    lines = chart_lines(spark, path)
    is_header = F.lower(F.col("cells")[0]) == STAMP
    headers = lines.where(is_header).groupBy("file").agg(F.min("cells").alias("named")).select(
        "file", F.explode(header_columns(F.col("named"))).alias("c")
    ).groupBy("file").agg(F.collect_list("c").alias("columns"))
    rows = lines.where(~is_header).join(headers, "file").select(
        "file", F.col("cells")[0].alias("stamp"), F.explode(F.transform("columns", lambda c: F.struct(c["dim"], c["unit"], F.get("cells", c["position"]).alias("cell")))).alias("m")
    )
    number = F.when(F.col("m.cell") != MISSING, F.col("m.cell")).try_cast("double")
    ts = F.when(F.col("stamp").rlike(r"^\d+$"), local_from_millis(F.col("stamp").try_cast("bigint"))).otherwise(on_date(run_date, F.col("stamp")))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    host = F.when(name.startswith("p-") | name.rlike(r"_p\.csv$"), "primary").otherwise("backup")
    chart = F.regexp_replace(F.regexp_replace(name, r"(_p)?\.csv$", ""), r"^[pr]-|-(converted|raw)$", "")
    out = rows.select(
        F.col("file"), host.alias("host"), chart.alias("chart"), F.col("m.dim").alias("dim"), F.col("m.unit").alias("unit"), ts.alias("ts"),
        (F.coalesce(number, F.lit(0.0)) if null_policy == "zero" else number).alias("value"),
    ).where("ts IS NOT NULL")
    return out if null_policy == "zero" else out.where("value IS NOT NULL")
