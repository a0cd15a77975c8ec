"""Removal of lines that many documents share.

Lines are exploded, normalised (blanks stripped at both ends, A-Z lower-cased) and hashed to 128 bits. A hash found
in `min_docs` documents is frequent; its lines go everywhere but in the document with the largest id that holds it.
What is left is put together again by position.

1. One row a counted line: id, hash of the text, place, hash of the key. Only these narrow rows are grouped.
2. Documents per key: distinct (key, id), then a count. Both groupings start inside the tasks, so a line that a third
   of all documents hold is one partial sum a task.
3. Frequent keys meet the lines again. A key with more than 1 / HEAVY_SHARE of all lines is a heavy one; there are
   fewer than HEAVY_SHARE of them whatever the input is, so they are broadcast. All other keys meet by shuffle, where
   none has enough lines to fill a task.
4. Dropped places are gathered per text (no more than it has lines) and joined to the texts once.

Null ids are one document of their own that never is the keeper. Null and empty texts are one empty line. Keys
shorter than `min_chars` code points are never counted. Rows that are wholly equal are one document and keep their
lines alike; rows with one id and several texts are one document. Long texts are cut into lines inside a row; the
last step works on slices of bounded bytes. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import BLANKS, only, slices
from cycle_analytics.session import written

MIN_CHARS = 20
MIN_DOCS = 3
HEAVY_SHARE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without blanks around it, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text) and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def counted_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """id, th, pos, h1, h2 of every line whose key is long enough."""
    lines = texts.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        "id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


def frequent_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, n_docs, keeper of the keys that enough documents hold."""
    held = lines.select(*KEY, "id").distinct()
    return held.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(
        F.col("n_docs") >= min_docs
    )


def dropped_places(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """id, th, pos of the lines that go."""
    total = lines.select(F.count("*")).scalar()
    is_heavy = F.col("n_docs") * HEAVY_SHARE > total
    heavy = frequent.where(is_heavy).select(*KEY, F.col("keeper").alias("heavy_keeper"), F.lit(True).alias("heavy"))
    light = frequent.where(~is_heavy).select(*KEY, "keeper")
    told = lines.join(F.broadcast(heavy), KEY, "left")
    by_heavy = told.where("heavy AND NOT id <=> heavy_keeper")
    by_light = told.where("heavy IS NULL").join(light, KEY).where("NOT id <=> keeper")
    return by_heavy.select("id", "th", "pos").unionAll(by_light.select("id", "th", "pos"))


def cut_lines(met: DataFrame) -> DataFrame:
    """Rows (id, text, places) put together again: id, n_lines, n_dropped, kept_sha256, kept_text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                out = []
                for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    lines = text.split("\n")
                    if places:
                        stays = np.ones(len(lines), bool)
                        stays[places] = False
                        text = "\n".join([lines[k] for k in np.nonzero(stays)[0]])
                    out.append((len(lines), len(places or ()), sha256(text.encode()).hexdigest(), text))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))],
                    names=["id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
                )

    kind = met.schema["id"].dataType.simpleString()
    return met.mapInArrow(cut, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string, kept_text string")


def without_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256, kept_text, one row per input row."""
    texts = keyed_texts(docs, id_col, text_col)
    lines = written(counted_lines(texts, min_chars), "counted-lines")
    frequent = written(frequent_keys(lines, min_docs), "frequent-lines")
    gone = dropped_places(lines, frequent).groupBy(F.col("id").alias("other_id"), F.col("th").alias("other_th")).agg(
        F.collect_set("pos").alias("places")
    )
    same = F.col("id").eqNullSafe(F.col("other_id")) & (F.col("th") == F.col("other_th"))
    met = texts.join(gone, same, "left").select("id", "text", "places")
    return cut_lines(met).withColumnRenamed("id", id_col)


def run_query(docs: DataFrame) -> DataFrame:
    return without_shared_lines(only(docs, "doc_id", "text")).drop("kept_text")
