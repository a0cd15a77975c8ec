"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression over the words and lines of a text, and every rule is one row of
`RULES`; `quality_rules` turns the table into one `select` without user functions and without a shuffle.

Null, empty and blank texts have no words; they fail the base rule. Repeated rows are judged alike.
Extra columns of the input are left alone: only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import BLANK_RUN, only

SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that der die das und ein eine ist zu le la les de des et un une est que el los las y en por"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# One row a rule: name, numerator, factor, comparison that rejects, limit, denominator.
# A text is rejected where factor * numerator <op> limit * denominator.
RULES: tuple[tuple[str, str, int, str, int, str], ...] = (
    ("short_words", "word_chars", 1, "<", 2, "n_words"),
    ("long_words", "word_chars", 1, ">", 20, "n_words"),
    ("symbols", "n_symbols", 100, ">", 10, "n_words"),
    ("dup_lines", "n_dup_lines", 100, ">", 60, "n_lines"),
    ("stop_words", "n_stop_words", 1, "<", 1, "one"),
)


def window_hashes(hashes: Column) -> Column:
    """A 64-bit hash of each 3-word window."""
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )


# Windows as whole numbers, hash above place, in order; only where some window is found twice.
ORDERED = """
    CASE WHEN size(array_distinct(windows)) < size(windows)
         THEN sort_array(transform(windows, (h, i) -> shiftleft(h, place_bits) | i))
         ELSE slice(windows, 1, 0) END
"""
# The place of every window whose hash stands next to an equal one.
PLACES = """
    transform(
        filter(ordered, (x, k) ->
            shiftright(x, place_bits) = shiftright(get(ordered, k + 1), place_bits)
            OR (k > 0 AND shiftright(x, place_bits) = shiftright(get(ordered, k - 1), place_bits))),
        x -> x & (shiftleft(1L, place_bits) - 1))
"""


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The measures of every text, one row each.

    The steps are projections of their own: a lambda must refer to finished columns, or their expressions
    would be evaluated anew for every element. Windows are compared by a hash of their words, which keeps
    64 bits less those that the number of words takes.
    """
    stop = [F.lit(form) for word in STOP_WORDS for form in (word, word.capitalize())]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select(
        "id", "text",
        F.filter(F.split("text", BLANK_RUN), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    counted = split.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(*stop))).cast("long").alias("n_stop_words"),
        F.length(F.bin(F.size("words"))).alias("place_bits"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    measures = [c for c in counted.columns if c not in ("hashes", "place_bits")]
    paired = counted.select(*measures, "place_bits", window_hashes(F.col("hashes")).alias("windows"))
    ordered = paired.select(*measures, "place_bits", F.expr(ORDERED).alias("ordered"))
    places = ordered.select(*measures, F.expr(PLACES).alias("places"))
    covered = F.flatten(F.transform("places", lambda i: F.array(i, i + 1, i + 2)))
    # Not deterministic on paper, so that filters on verdicts stay above instead of repeating all of this.
    count = F.when(F.monotonically_increasing_id() >= 0, F.size(F.array_distinct(covered)))
    return places.select(
        *measures, count.cast("long").alias("n_repeat_words"),
        F.lit(1).cast("long").alias("one"),
    )


def rule_fails(rule: tuple[str, str, int, str, int, str]) -> Column:
    _, value, factor, op, limit, base = rule
    left, right = F.col(value) * factor, F.col(base) * limit
    return left < right if op == "<" else left > right


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
) -> DataFrame:
    """Measures, the failed rules and the verdict of every text.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, kept.
    """
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    failed = F.array_compact(F.array(*[F.when(rule_fails(rule), F.lit(rule[0])) for rule in rules]))
    return measured(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), failed.alias("failed_rules"),
        (~base & (F.size(failed) == 0)).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with their own columns.

    The verdict is computed beside the row, so no join is needed and repeated ids keep their own verdicts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = quality_rules(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text")
    return judged.where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def run_query(docs: DataFrame) -> DataFrame:
    return quality_rules(only(docs, "doc_id", "text")).drop("failed_rules")
