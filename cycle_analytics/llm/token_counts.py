"""Token counts of every prefix, by dynamic programming over prefixes.

`counts[i]` is the number of tokens that the first i + 1 characters of a text encode to. Two levels share the work:

* Inside a piece (what the splitting pattern cuts out before merging) the last token of each byte prefix is
  found from shorter prefixes: among the vocabulary entries that end there, it is the one whose pair with the
  last token before it survives re-merging. Exactly one does. The count is one more than that of the shorter
  prefix. Pieces repeat and share beginnings, so each piece and each short prefix is solved once per worker.
* Across pieces the counts add up. A prefix that ends behind a whole run of blanks is the one place where
  cutting the text changes an earlier piece; it is counted as a run of its own.

Truncation and budget questions are then look-ups in the stored array (`tokens_of_prefix`, `longest_prefix`).

Null and empty texts have no prefixes and 0 tokens. Repeated rows are counted alike; extra columns are left alone.
A text of any length is handled whole: its counts take four bytes a character, batches are cut to a few megabytes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only, slices

LIMIT = 1024
# The splitting pattern of the byte-level vocabulary and its contractions of three characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
USUAL = [*range(0x250), *range(0x2000, 0x2065), 0x20AC]
UNUSUAL = re.compile(r"[^\u0000-\u024f\u2000-\u2064\u20ac]")
BLANK_RUNS = regex.compile(r"\s{2,}(?=\S)")
CACHED_PIECES = 400_000
CACHED_PREFIXES = 1_000_000
KEPT_PREFIX = 32
TOKEN_BITS = 32


def usual_pattern() -> re.Pattern:
    """The splitting pattern for texts of usual characters only, with its classes written out."""
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in USUAL if regex.match(kind, chr(c)))

    letters, numbers, blanks = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    told = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]")
    told = told.replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]")
    return re.compile(told)


PIECES = usual_pattern()


class Solved(dict):
    """Remembered pieces; what is not known is solved when it is looked up."""

    def __init__(self, solve):
        self.solve = solve

    def __missing__(self, piece: str) -> bytes:
        found = self.solve(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = found
        return found


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file: visible bytes as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Exact token counts of all character prefixes under one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = byte_characters()
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        entries = {bytes(back[c] for c in text): number for text, number in spec["model"]["vocab"].items()
                   if text not in self.specials}
        self.bytes_of = {number: entry for entry, number in entries.items()}
        self.ids = entries
        self.longest = max(map(len, entries))
        # What two neighbours merge to is known by its order; a token remembers the merge that made it.
        self.order: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(back[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            self.order[entries[left], entries[right]] = order
            self.made.setdefault(entries[left + right], (order, entries[left], entries[right]))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[bytes, int] = {}  # count and last token of short prefixes
        self.solved = Solved(self.steps)
        self.splitter = None
        self.path = path

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are left as they are by merging their bytes anew.

        Goes back through the merges that made them, the latest first. The parts that touch at the border
        would have merged with each other if that merge came before either was used up by its own token;
        of two merges of the same order the one further left comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            known, a, b, a_used, b_used = True, left, right, 1 << 60, 1 << 60
            while True:
                order = self.order.get((a, b))
                if order is not None and order < a_used and order <= b_used:
                    known = False
                    break
                a_made, b_made = self.made.get(a), self.made.get(b)
                if a_made is None and b_made is None:
                    break
                if b_made is None or (a_made is not None and a_made[0] > b_made[0]):
                    a_used, a = a_made[0], a_made[2]
                else:
                    b_used, b = b_made[0], b_made[1]
            if len(self.pairs) >= 4 * CACHED_PIECES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Token count of each byte prefix of a piece, the empty one included."""
        ids, stays, longest, known = self.ids, self.stays, self.longest, self.prefixes
        counts, last, mask = [0], [-1], (1 << TOKEN_BITS) - 1
        for end in range(1, min(len(data), KEPT_PREFIX) + 1):
            told = known.get(data[:end])
            if told is None:
                break
            counts.append(told >> TOKEN_BITS)
            last.append(told & mask)
        if len(known) >= CACHED_PREFIXES:
            known.clear()
        for end in range(len(counts), len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (start == 0 or stays(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            if end <= KEPT_PREFIX:
                known[data[:end]] = counts[end] << TOKEN_BITS | last[end]
        return counts

    def piece_counts(self, piece: str) -> list[int]:
        """Token count of each character prefix of a piece."""
        data = piece.encode()
        counts = self.byte_counts(data)
        if len(data) == len(piece):
            del counts[0]
        else:
            counts = [counts[end] for end in accumulate(len(c.encode()) for c in piece)]
        if piece in LONG_CONTRACTIONS:  # cut short, the quote and the letter are pieces of their own
            counts[1] = 2
        return counts

    def steps(self, piece: str) -> bytes:
        """The growth of the count at each character of a piece, packed so that pieces can be joined."""
        counts = self.piece_counts(piece)
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text. Beyond Latin letters the library cuts, as its Unicode tables may be older or newer."""
        if text.isascii() or not UNUSUAL.search(text):
            return PIECES.findall(text)
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings."""
        steps = np.frombuffer(b"".join(map(self.solved.__getitem__, self.pieces(text))), np.int16)
        counts = np.cumsum(steps, dtype=np.int32)
        for run in BLANK_RUNS.finditer(text):
            before = counts[run.start() - 1] if run.start() else 0
            counts[run.end() - 1] = before + int(np.frombuffer(self.solved[run[0]], np.int16).sum())
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Counts of all prefixes; a special string is one token once it is whole."""
        if self.special_split is None or not any(s in text for s in self.specials):
            return self.ordinary(text)
        parts, base, at = [], 0, 0
        for special in self.special_split.finditer(text):
            part = self.ordinary(text[at : special.end()])
            inside = special.start() - at
            part[-1] = (part[inside - 1] if inside else 0) + 1
            parts.append(part + base)
            base, at = base + int(part[-1]), special.end()
        parts.append(self.ordinary(text[at:]) + base)
        return np.concatenate(parts)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prefix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
) -> DataFrame:
    """The prefix table: id, n_bytes, prefix_tokens (one count a character), one row per text. No shuffle."""
    path = vocabulary or default_vocabulary()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = counter(path)
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                texts = batch.column(1).to_pylist()
                found = [solver.counts(t) if t else np.zeros(0, np.int32) for t in texts]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), sizes.cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values))],
                    names=["id", "n_bytes", "prefix_tokens"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    solved = frame.mapInArrow(solve, f"id {id_type}, n_bytes long, prefix_tokens array<int>")
    return solved.withColumnRenamed("id", id_col)


def tokens_of_prefix(characters: Column | int) -> Column:
    """Tokens of the first `characters` characters; of the whole text if it is shorter."""
    place = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size("prefix_tokens"))
    return F.when(place < 1, F.lit(0)).otherwise(F.get("prefix_tokens", place - 1))


def longest_prefix(budget: int) -> Column:
    """Characters of the longest prefix that encodes to at most `budget` tokens."""
    fits = F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))


def run_query(docs: DataFrame) -> DataFrame:
    stored = prefix_counts(only(docs, "doc_id", "text"))
    tokens = tokens_of_prefix(F.size("prefix_tokens")).cast("long")
    return stored.select("doc_id", "n_bytes", tokens.alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > LIMIT
    )
