"""A counterfactual-regularised toxicity classifier.

Features are the words of a text and their beginnings (inflected and compound forms share them), present or not.
Those that tell the labels apart are counted by Spark over
the labelled rows; a logistic model over them is fitted with a penalty on the score's change when an identity term
is swapped for another of its group. Neutral mentions of a group then move the score no more than those of any
other group. Identity terms have no beginnings, so the term itself is all that a swap changes, and the penalty sees
all of it; other words keep theirs.

Bounds: at most `max_rows` labelled rows (those with the smallest hash of their id) and `max_words` words take part
in the fit, which runs in one task on word numbers alone. The model - that many words with a weight - is sent to
the scoring tasks. Every text is scored whole.

Labels are used only from rows whose crc32 of the id, modulo 4, is not 2, and only for the fit. Null and empty texts
have no words and get the base score. Labels other than 0 and 1 and null ids are not used; of several labels of
one id the larger counts. Equal texts with equal labels count once in the fit. Without any usable label all scores
are 0.5's base rate: 0. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only, slices
from cycle_analytics.session import written

MAX_ROWS = 20_000
MAX_WORDS = 2_000
THRESHOLD = 0.3
LEAST_Z = 4.0
PENALTY = 1.0
RIDGE = 1e-3
STEPS = 400
BEGINNINGS = (4, 5, 6, 7)
WORD = regex.compile(r"[\p{L}\p{M}]+")

# Groups of identity terms that may stand in for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(groups) -> frozenset[str]:
    return frozenset(term for group in groups for term in group)


IDENTITY_TERMS = terms_of(IDENTITY_GROUPS)


def features_of(text: str | None, terms: frozenset[str] = IDENTITY_TERMS) -> set[str]:
    """The words of a text, and their beginnings marked with a star, those of identity terms left out."""
    words = set(WORD.findall(text.lower())) if text else set()
    others = words - terms
    return words.union(*({word[:n] + "*" for word in others if len(word) > n} for n in BEGINNINGS))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int,
    terms: frozenset[str] = IDENTITY_TERMS,
) -> DataFrame:
    """label and distinct words of the labelled rows that the fit may see, equal ones once."""
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    chosen = usable.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # At most `max_rows` ids and labels.
    met = rows.join(F.broadcast(chosen), "id").select("label", "text", F.xxhash64("text").alias("th"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                words = [sorted(features_of(t, terms)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words, pa.list_(pa.string())), batch.column(2)], names=["label", "words", "th"]
                )

    once = met.mapInArrow(cut, "label int, words array<string>, th long").dropDuplicates(["label", "th"])
    return once.select("label", "words")


def telling_features(rows: DataFrame, max_words: int) -> list[str]:
    """The features whose share differs most between the labels, by the z value of the log odds; at most `max_words`."""
    sizes = rows.agg(F.sum("label").cast("double").alias("pos"), F.count("*").cast("double").alias("all"))
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n")
    )
    pos = sizes.select("pos").scalar()
    neg = sizes.select(F.col("all") - F.col("pos")).scalar()
    a, b = F.col("p") + 0.5, F.col("n") - F.col("p") + 0.5
    odds = F.log(a / (pos - F.col("p") + 0.5)) - F.log(b / (neg - F.col("n") + F.col("p") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b)
    ranked = counts.where("n >= 5").withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    return [r["word"] for r in ranked.orderBy(F.col("z").desc(), "word").limit(max_words).collect()]


def fit(labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_words: int, swaps: np.ndarray, swap_counts: np.ndarray):
    """Weights and intercept of the penalised logistic model by accelerated gradient steps.

    rows, columns: the present words, entry by entry. swaps: pairs of word numbers that may be swapped, with the
    number of texts in which the first stands.
    """
    n = len(labels)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    weights, bias = np.zeros(n_words), float(np.log(share / (1 - share)))
    first, second = np.zeros((2, n_words)), np.zeros(2)
    for step in range(1, STEPS + 1):
        score = bias + np.bincount(rows, weights[columns], minlength=n)
        error = 1 / (1 + np.exp(-score)) - labels
        slope = np.bincount(columns, error[rows], minlength=n_words) / n + RIDGE * weights
        if len(swaps):
            change = PENALTY * swap_counts * (weights[swaps[:, 0]] - weights[swaps[:, 1]]) / n
            slope += np.bincount(swaps[:, 0], change, minlength=n_words)
            slope -= np.bincount(swaps[:, 1], change, minlength=n_words)
        first[0], first[1] = 0.9 * first[0] + 0.1 * slope, 0.99 * first[1] + 0.01 * slope**2
        second[0], second[1] = 0.9 * second[0] + 0.1 * error.mean(), 0.99 * second[1] + 0.01 * error.mean() ** 2
        rate = 0.1 / (1 + step / 100)
        low, high = 1 - 0.9**step, 1 - 0.99**step
        weights -= rate * (first[0] / low) / (np.sqrt(first[1] / high) + 1e-6)
        bias -= rate * (second[0] / low) / (np.sqrt(second[1] / high) + 1e-6)
    return weights, bias


def model_of(rows: DataFrame, telling: list[str], groups=IDENTITY_GROUPS) -> dict[str, float]:
    """Weight of each word; the intercept under the empty word."""
    identity = sorted(terms_of(groups))
    words = telling + [t for t in identity if t not in set(telling)]
    number = {word: k for k, word in enumerate(words)}
    pairs = [(number[a], number[b]) for group in groups for a in group for b in group if a != b]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[number[w] for w in words_ if w in number] for words_ in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"]
            )

    def train(table: pa.Table) -> pa.Table:
        labels = table.column("label").to_numpy().astype(np.float64)
        found = table.column("found").to_pylist()
        rows_ = np.repeat(np.arange(len(found)), [len(f) for f in found])
        columns = np.array([c for f in found for c in f], np.int64)
        held = np.bincount(columns, minlength=len(words))
        swaps = np.array([p for p in pairs if held[p[0]]], np.int64).reshape(-1, 2)
        weights, bias = fit(labels, rows_, columns, len(words), swaps, held[swaps[:, 0]])
        return pa.table({"word": ["", *words], "weight": [bias, *weights.tolist()]})

    small = rows.mapInArrow(numbered, "label int, found array<int>")
    fitted = small.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "word string, weight double")
    return {r["word"]: r["weight"] for r in fitted.collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, groups=IDENTITY_GROUPS) -> dict[str, float]:
    """The fitted model, empty without usable labels."""
    rows = written(training_rows(docs, labels, id_col, text_col, label_col, max_rows, terms_of(groups)), "toxic-words")
    return model_of(rows, telling_features(rows, max_words), groups)


def score(
    docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text", groups=IDENTITY_GROUPS
) -> DataFrame:
    """id and score of every text, with the groups that the model was trained with. No shuffle."""
    terms = terms_of(groups)
    base = model.get("")
    weights = {w: v for w, v in model.items() if w}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                if base is None:
                    scores = np.zeros(batch.num_rows)
                else:
                    sums = [
                        base + sum(sorted(weights[w] for w in features_of(t, terms) & weights.keys())) for t in batch.column(1).to_pylist()
                    ]
                    scores = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(solve, f"id {kind}, score double").withColumnRenamed("id", id_col)


def run_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = only(docs, "doc_id", "text")
    scored = score(docs, train(docs, only(labels, "doc_id", "toxic")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
