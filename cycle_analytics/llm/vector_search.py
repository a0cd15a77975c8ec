"""Exact top-k search by inner product with vector-approximation files.

Components are whole numbers, floor(256 x). The file of cells is made once and written: a step per block, one signed
byte a component, and the length of what the cells leave out of each vector. The scan reads cells only. They bound
a score: the score of the cells' centres, give or take what the rest can add - at most half a step times the query's
absolute sum, and at most the query's length times the length of the rest. A vector whose upper bound is below
the k-th best lower bound is out, first within its block, then among all blocks; exact vectors are read for those
that are left, and their exact scores decide.

Vectors with equal components are one unit with its smallest ids: ties go to the smaller id, so of any number of
copies only the first k + 1 rows can count. Each distinct query vector is asked once, for k + 1 rows; a query's own
row is taken from its answer afterwards. A table in which a third of all rows is one vector is thus a small one.

Queries and cells meet in blocks of fixed size, query rows against all rows as stated. Vectors that are null, hold
null or non-finite components, or have no id take no part. Repeated rows are rows of their own: each finds its twins.
Vectors of another length than the query's are no candidates. Any finite component counts: products beyond 63 bits
are summed exactly, and a score beyond 64 bits is given as the nearest 64-bit number. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only
from cycle_analytics.session import written

SCALE = 256
BLOCK = 8192
QUERY_BLOCK = 512
LARGEST = 1.7e308
WHOLE = float(1 << 53)
KEY = ["m1", "m2"]
SLACK = 1e-9
ROUNDING = 1e-12
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def whole_number(x: Column) -> Column:
    """floor(256 x) as a double; from 2^53 on every double is whole."""
    y = F.least(F.greatest(x.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, values, dims and the 128-bit key (m1, m2) of the values, of the rows that take part."""
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("raw"))
    taken = rows.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull()).where(sound)
    # -0.0 and 0.0 are one number.
    values = taken.select("vec_id", F.transform("raw", lambda x: whole_number(x) + 0.0).alias("values"))
    return values.select(
        "vec_id", "values", F.size("values").alias("dims"), F.xxhash64("values").alias("m1"), F.xxhash64(F.lit("v"), "values").alias("m2")
    )


def units(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids, repeated rows counted: m1, m2, dims, values, ids."""
    first = Window.partitionBy("dims", *KEY).orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    return few.groupBy("dims", *KEY).agg(F.first("values").alias("values"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with the number of their block of about `size` rows, per length of vectors."""
    counts = rows.groupBy("dims").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(counts, "dims").withColumn(name, F.pmod("m1", "blocks")).drop("blocks")


CELLS = "dims int, block bigint, step double, keys binary, cells binary, rests binary"


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


def cell_file(found: DataFrame) -> DataFrame:
    """The cells of all units, one row a block."""

    def quantise(block: pa.Table) -> pa.Table:
        dims = block.column("dims")[0].as_py()
        exact = matrix(block.column("values"), dims)
        top = float(np.abs(exact).max(initial=0.0))
        step = 2.0 ** max(0, int(np.ceil(np.log2(max(top, 1.0) / 126.0))))
        cells = np.floor(exact / step).astype(np.int8)
        with np.errstate(over="ignore"):
            rest = exact - centres(cells, step)
            rests = np.sqrt((rest * rest).sum(1)) * (1 + SLACK)
        keys = np.stack([block.column(c).to_numpy() for c in KEY], 1)
        return pa.table({
            "dims": pa.array([dims], pa.int32()), "block": pa.array([block.column("block")[0].as_py()], pa.int64()), "step": [step],
            "keys": [keys.tobytes()], "cells": [cells.tobytes()], "rests": [rests.tobytes()],
        })

    placed = dealt(found.select("dims", *KEY, "values"), BLOCK, "block")
    return placed.groupBy("dims", "block").applyInArrow(quantise, CELLS)


def centres(cells: np.ndarray, step: float) -> np.ndarray:
    """The middle of the whole numbers of each cell."""
    return cells.astype(np.float64) * step + (step - 1) / 2


def bounds(asked: np.ndarray, cells: np.ndarray, rests: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all (query, vector) pairs."""
    with np.errstate(over="ignore", invalid="ignore"):
        sums, middle = np.abs(asked).sum(1)[:, None], centres(cells, step)
        near = asked @ middle.T
        slack = np.minimum((step - 1) / 2 * sums, np.sqrt((asked * asked).sum(1))[:, None] * rests[None, :])
        # Rounding of the product grows with the sizes of its terms.
        slack = slack * (1 + SLACK) + sums * np.abs(middle).max(initial=0.0) * ROUNDING + 1e-3
        lower, upper = near - slack, near + slack
    return np.nan_to_num(lower, nan=-np.inf, neginf=-np.inf, posinf=np.inf), np.nan_to_num(upper, nan=np.inf, neginf=-np.inf, posinf=np.inf)


def candidates(file: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q1, q2, m1, m2, lower, upper): what the cells of a block cannot rule out for the k best of a query."""
    questions = dealt(asked, QUERY_BLOCK, "question").groupBy("dims", "question").agg(F.collect_list(F.struct(*KEY, "values")).alias("rows")).select(
        "dims", "question", F.col("rows.m1").alias("q1"), F.col("rows.m2").alias("q2"), F.flatten("rows.values").alias("values")
    )
    pairs = questions.select("dims", "question").join(file.select("dims", "block"), "dims")
    met = pairs.join(file, ["dims", "block"]).join(questions, ["dims", "question"]).select(
        "dims", "q1", "q2", "values", "step", "keys", "cells", "rests"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims, step = batch.column(0)[row].as_py(), batch.column(4)[row].as_py()
                q1, q2 = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                queries = batch.column(3)[row].values.to_numpy(zero_copy_only=False).reshape(len(q1), dims)
                keys = np.frombuffer(batch.column(5)[row].as_py(), np.int64).reshape(-1, 2)
                cells = np.frombuffer(batch.column(6)[row].as_py(), np.int8).reshape(len(keys), dims)
                rests = np.frombuffer(batch.column(7)[row].as_py(), np.float64)
                lower, upper = bounds(queries, cells, rests, step)
                if len(keys) > k:
                    least = np.partition(lower, len(keys) - k, axis=1)[:, len(keys) - k]
                    q, v = np.nonzero(upper >= least[:, None])
                else:
                    q, v = np.nonzero(np.ones(upper.shape, bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q1[q]), pa.array(q2[q]), pa.array(keys[v, 0]), pa.array(keys[v, 1]), pa.array(lower[q, v]), pa.array(upper[q, v])],
                    names=["q1", "q2", "m1", "m2", "lower", "upper"],
                )

    return met.mapInArrow(scan, "q1 long, q2 long, m1 long, m2 long, lower double, upper double")


def exact_scores(pairs: DataFrame) -> DataFrame:
    """q1, q2, m1, m2, ids, score of (asked, values) pairs; exact whatever the size of the numbers."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b in zip(batch.column(5), batch.column(6)):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (a, b))
                if np.abs(x).max(initial=0.0) * np.abs(y).max(initial=0.0) * (len(x) + 1) < float(1 << 62):
                    scores.append(int(x.astype(np.int64) @ y.astype(np.int64)))
                else:
                    total = sum(int(p) * int(q) for p, q in zip(x.tolist(), y.tolist()))
                    scores.append(min(max(total, LOW), HIGH))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(5)), pa.array(scores, pa.int64())], names=["q1", "q2", "m1", "m2", "ids", "score"]
            )

    columns = pairs.select("q1", "q2", "m1", "m2", "ids", "asked", "values")
    return columns.mapInArrow(multiply, "q1 long, q2 long, m1 long, m2 long, ids array<long>, score long")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k best rows of `vectors` for every row of `queries`, its own excepted: query_id, rank (from 1), vec_id, score."""
    found = written(units(whole_vectors(vectors, id_col, vector_col), k), "vector-units")
    file = written(cell_file(found), "vector-cells")
    rows = written(whole_vectors(queries, id_col, vector_col), "vector-queries")
    asked = rows.groupBy("dims", *KEY).agg(F.first("values").alias("values"))
    left = candidates(file, asked, k + 1)
    by_bound = Window.partitionBy("q1", "q2").orderBy(F.col("lower").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    certain = F.coalesce(F.nth_value("lower", k + 1).over(by_bound), F.lit(float("-inf")))
    needed = left.withColumn("least", certain).where("upper >= least").select("q1", "q2", *KEY)
    named = asked.select(F.col("m1").alias("q1"), F.col("m2").alias("q2"), F.col("values").alias("asked"))
    scored = exact_scores(needed.join(found.select(*KEY, "values", "ids"), KEY).join(named, ["q1", "q2"]))
    hits = scored.select("q1", "q2", "score", F.explode("ids").alias("vec_id"), ((F.col("q1") == F.col("m1")) & (F.col("q2") == F.col("m2"))).alias("alike"))
    best = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), "vec_id")
    few = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = few.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "alike"))).alias("hits"))
    met = rows.select(F.col("vec_id").alias("query_id"), F.col("m1").alias("q1"), F.col("m2").alias("q2")).join(answers, ["q1", "q2"])
    # A query's own row is the first of its id among the rows that are like it; without it k + 1 others are as good.
    own = F.array_min(F.transform(F.filter("hits", lambda h: h["alike"] & (h["vec_id"] == F.col("query_id"))), lambda h: h["place"]))
    others = F.slice(F.filter("hits", lambda h: ~h["place"].eqNullSafe(F.col("own"))), 1, k)
    listed = met.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def run_query(embeddings: DataFrame) -> DataFrame:
    rows = only(embeddings, "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
