"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, language, topic). Each sweep scales the cells so that one marginal after
the other has its target tokens; after enough sweeps all of them do. One scale for all cells then makes the expected
tokens meet the budget. A cell's factor times the scale is the mean number of copies of its documents: up to 1 it is
the `probability`, above 1 the `weight`, and the other of the two is 1. A document gets the whole part of it as
copies, and one more with the rest as the chance, so the sample has the target shares also where factors exceed 1.

Only cells go through the sweeps; the pass over documents is one aggregation and one join. A cell's rows are not
gathered. The scale and the largest error of a sweep are single numbers.

Targets default to the marginal's own shares raised to a temperature below 1, which lifts small groups. Null source,
language or topic are groups of their own. Null and empty texts weigh nothing and follow their cell; a cell
without any tokens is kept whole. A null id draws like any other value; repeated rows draw alike. Empty tables
give no rows. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only
from cycle_analytics.session import written

TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.8
SWEEPS_A_ROUND = 4
MAX_ROUNDS = 12
TOLERANCE = 1e-4
SEED = 7
BYTES_A_TOKEN = 4


def topic_of(text: Column) -> Column:
    """A coarse topic from marks that a text carries."""
    return (
        F.when(text.rlike("(?i)licen[sc]e|copyright"), "legal")
        .when(text.rlike("[\\w.]+@[\\w.]+\\.\\w"), "contact")
        .when(text.rlike("\\d{4,}"), "figures")
        .when(text.rlike("\\n[^\\n]*\\n"), "long form")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Token weight of a text, estimated from its bytes."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / BYTES_A_TOKEN).cast("long")


def in_cells(
    docs: DataFrame, text_col: str, source_col: str, lang_col: str, token_col: str | None = None
) -> tuple[Column, ...]:
    text = F.col(f"`{text_col}`")
    tokens = tokens_of(text) if token_col is None else F.coalesce(F.col(f"`{token_col}`").cast("long"), F.lit(0).cast("long"))
    return (
        F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"),
        topic_of(F.coalesce(text, F.lit(""))).alias("topic"), tokens.alias("tokens"),
    )


def with_targets(cells: DataFrame, targets: dict[str, DataFrame], temperatures: dict[str, float]) -> DataFrame:
    """Cells with the target tokens of each of their groups, scaled to the same total."""
    total = cells.select(F.sum("tokens").cast("double")).scalar()
    for margin, temperature in temperatures.items():
        held = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("held"))
        if margin in targets:
            given = targets[margin].select(F.col(margin).alias("group"), F.col("weight").cast("double").alias("wanted"))
            sized = held.join(given, held[margin].eqNullSafe(given["group"]), "left")
            sized = sized.select(margin, F.when(F.col("held") > 0, F.coalesce("wanted", F.lit(0.0))).alias("wanted"))
        else:
            sized = held.select(margin, F.pow("held", F.lit(temperature)).alias("wanted"))
        whole = sized.select(F.sum("wanted")).scalar()
        aimed = sized.select(
            F.col(margin).alias("group"), (F.col("wanted") / F.nullif(whole, F.lit(0.0)) * total).alias(f"{margin}_target")
        )
        cells = cells.join(aimed, cells[margin].eqNullSafe(aimed["group"]), "left").drop("group")
    return cells


def swept(cells: DataFrame, margins: list[str]) -> DataFrame:
    """One sweep: every marginal is brought to its target in turn."""
    for margin in margins:
        now = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(margin))
        cells = cells.withColumn(
            "factor", F.when(now > 0, F.col("factor") * F.col(f"{margin}_target") / now).otherwise(F.col("factor"))
        )
    return cells


def largest_error(cells: DataFrame, margins: list[str]) -> float:
    """The largest relative distance of a group from its target."""
    errors = []
    for margin in margins:
        now = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(margin))
        target = F.col(f"{margin}_target")
        errors.append(F.when(target > 0, F.abs(now - target) / target).otherwise(F.lit(0.0)))
    return cells.select(F.greatest(*errors).alias("error")).agg(F.max("error")).first()[0] or 0.0


def fitted(cells: DataFrame, margins: list[str]) -> DataFrame:
    """Cells with the factor that brings all marginals to their targets, as near as they allow."""
    cells = cells.withColumn("factor", F.lit(1.0))
    for _ in range(MAX_ROUNDS):
        for _ in range(SWEEPS_A_ROUND):
            cells = swept(cells, margins)
        cells = written(cells, "mix-cells")
        if largest_error(cells, margins) <= TOLERANCE:
            break
    return cells


def scale_for(cells: DataFrame, budget: float) -> float:
    """The scale that makes the expected tokens of all copies meet the budget."""
    total, raked = cells.select(
        F.sum("tokens").cast("double"), F.sum(F.col("tokens") * F.col("factor"))
    ).first()
    return budget * total / raked if total and raked else 1.0


def mixture(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, temperatures: dict[str, float] | None = None,
    token_col: str | None = None,
) -> DataFrame:
    """Cells (source, lang, topic) with tokens, factor, probability and weight.

    `targets` maps a margin to a frame (margin, weight); margins without one use their temperature. `token_col` names
    a column of `docs` with token counts; without it a text weighs its bytes / 4.
    """
    temperatures = temperatures or TEMPERATURES
    summed = docs.select(*in_cells(docs, text_col, source_col, lang_col, token_col)).groupBy("source", "lang", "topic").agg(
        F.sum("tokens").alias("tokens")
    )
    cells = fitted(with_targets(written(summed, "mix-cells"), targets or {}, temperatures), list(temperatures))
    aimed = F.col("factor") * scale_for(cells, budget)
    empty = F.col("tokens") == 0
    return cells.select(
        "source", "lang", "topic", "tokens", "factor",
        F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), aimed)).alias("probability"),
        F.when(empty, 1.0).otherwise(F.greatest(F.lit(1.0), aimed)).alias("weight"),
    )


def drawn(id_: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11) / F.lit(float(1 << 53))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", token_col: str | None = None, **options) -> DataFrame:
    """All rows as `row` with source, lang, topic, tokens, probability, weight, whether they are sampled, and copies."""
    cells = mixture(docs, text_col, source_col, lang_col, token_col=token_col, **options).select(
        F.col("source").alias("c_source"), F.col("lang").alias("c_lang"), F.col("topic").alias("c_topic"),
        "probability", "weight",
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *in_cells(docs, text_col, source_col, lang_col, token_col),
    )
    same = (
        rows["source"].eqNullSafe(cells["c_source"]) & rows["lang"].eqNullSafe(cells["c_lang"])
        & (rows["topic"] == cells["c_topic"])
    )
    mean = F.col("probability") * F.col("weight")
    whole = F.floor(mean)
    copies = whole + (drawn(F.col("row")[id_col]) < mean - whole).cast("long")
    return rows.join(cells, same).select(
        "row", "source", "lang", "topic", "tokens", "probability", "weight",
        (copies > 0).alias("sampled"), copies.alias("copies"),
    )


def keep_sampled(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows with their own columns, each as often as it has copies."""
    taken = sample(docs, **options).where("sampled").select("row", F.explode(F.expr("sequence(1L, copies)")))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def run_query(docs: DataFrame) -> DataFrame:
    return sample(only(docs, "doc_id", "text", "source", "lang")).select(
        F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").alias("n_tokens"),
        "probability", "weight", "sampled", "copies",
    )
