"""Removal of long passages that occur anywhere else, with run-length indexes over the places that can repeat.

A window of `length` bytes is assigned to its anchor: the 128-byte string in it with the smallest hash, the first
of equals. Equal windows have equal anchors at equal places, wherever they stand, so windows only need comparing
under one anchor. The windows of one anchor are consecutive starts; their bytes are a span.

1. One pass lists the spans: anchor, a digest of the bytes, and where they stand. Anchors that occur once go.
2. Spans with equal bytes repeat as a whole, however many there are. One of them stands for all from here on.
3. Different spans under one anchor are gathered in blocks of bounded size; a run-length index (`run_index`) of
   the block marks the windows that occur in two of them.
4. An anchor whose different spans outgrow a block has no bounded index. Its windows are compared one by one
   by their 128-bit digests, which Spark counts with partial sums.
5. Marked windows become byte ranges per document, and the document is cut once.

A length can also be given in words. Every word then stands as 8 bytes, its hash, and the steps above run over
those; what is found is cut from the first to the last word, so blanks between words need not be the same.

Judgement is on the input: a passage is removed wherever it stands, the first time included. Null and empty texts
and those shorter than the length have nothing to remove. Rows that are wholly equal repeat each other. Matches
never cross documents. Where a cut goes through a character, the bytes left of it are dropped from the text that
`cut_documents` returns, but not from the digest of the bytes. Extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import freed, freed_group, only, slices
from cycle_analytics.llm.near_dup import MIX_A, MIX_B, STEP, hash_of, mixed
from cycle_analytics.llm.run_index import RunIndex
from cycle_analytics.session import written

LENGTH = 400
ANCHOR = 128
PIECE = 1 << 22  # positions handled at a time; fits the low bits of a key
BLOCK_BYTES = 1 << 20
SPAN_SCHEMA = "id {kind}, th long, anchor long, digest binary, start long, n int"
LOW = np.uint64((1 << 23) - 1)
WORD_BYTES = 8
LEAST_WORDS = ANCHOR // WORD_BYTES
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
Code = Callable[[str], bytes]


def as_bytes(text: str) -> bytes:
    return text.encode()


def as_words(text: str) -> bytes:
    """The hashes of the text's words, 8 bytes each."""
    words = text.encode().split()
    return np.fromiter(map(hash_of, words), np.uint64, len(words)).tobytes()


def owner_of(code: Code) -> str | None:
    """Whose memory a task keeps: words are told by the hashes that `near_dup` remembers."""
    return "near_dup" if code is as_words else None


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 128 bytes at each position, by doubling from 8 bytes on."""
    found = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    found = (found ^ (found >> np.uint64(29))) * MIX_A
    width = 8
    while width < ANCHOR:
        found = (found[: len(found) - width] * STEP) + (found[width:] ^ (found[width:] >> np.uint64(31)))
        width *= 2
    return mixed(found * MIX_B)


def window_anchors(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive keys."""
    n = len(keys)
    room = -(-n // width) * width
    padded = np.full(room, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    from_ = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_[: n - width + 1], upto[width - 1 : n])


def spans_of(data: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first start, number of starts) of the runs of windows with one anchor."""
    total = len(data) - length + 1
    whole = np.frombuffer(data, np.uint8)
    for first in range(0, total, PIECE):
        stop = min(total, first + PIECE)
        hashes = gram_hashes(whole[first : stop + length - 1])
        keys = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (window_anchors(keys, length - ANCHOR + 1) & LOW).astype(np.int64)
        turns = np.concatenate([[0], np.nonzero(chosen[1:] != chosen[:-1])[0] + 1, [len(chosen)]])
        anchors = hashes[chosen[turns[:-1]]].view(np.int64)
        yield from zip(anchors.tolist(), (turns[:-1] + first).tolist(), np.diff(turns).tolist())


def spans(rows: DataFrame, length: int, code: Code = as_bytes) -> DataFrame:
    """id, th (hash of the text), anchor, digest, start, n of every span of every text.

    Texts are coded where they are used: a Python step before this one would be a second worker beside each task's own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2_000_000):
                picked, found, digests = [], [], []
                for row, text in enumerate(batch.column(2).to_pylist()):
                    data = code(text) if text else b""
                    if len(data) < length:
                        continue
                    view = memoryview(data)
                    for span in spans_of(data, length):
                        picked.append(row)
                        found.append(span)
                        digests.append(xxhash.xxh3_128_digest(view[span[1] : span[1] + span[2] + length - 1]))
                taken = pa.array(picked, pa.int64())
                anchor, start, n = ([f[k] for f in found] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(anchor, pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(start, pa.int64()), pa.array(n, pa.int32())],
                    names=["id", "th", "anchor", "digest", "start", "n"],
                )

    return rows.mapInArrow(freed(cut, owner_of(code)), SPAN_SCHEMA.format(kind=rows.schema["id"].dataType.simpleString()))


def same_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (id, th), null ids included; the right side's keys go."""
    other = right.withColumnsRenamed({"id": "other_id", "th": "other_th"})
    met = left.join(other, left["id"].eqNullSafe(other["other_id"]) & (left["th"] == other["other_th"]), how)
    return met.drop("other_id", "other_th")


def with_bytes(reps: DataFrame, rows: DataFrame, length: int, code: Code = as_bytes) -> DataFrame:
    """Span rows (block, big, anchor, id, th, start, n, alone) with their bytes, cut out of the texts."""
    kind = rows.schema["id"].dataType.simpleString()
    wanted = reps.groupBy("id", "th").agg(
        F.collect_list(F.struct("start", "n", "anchor", "block", "big", "alone")).alias("wanted")
    )
    # Rows that are wholly equal have the same spans; one of them is enough. Only texts with spans get so far.
    met = same_document(rows, wanted, "inner").select("id", "th", "text", "wanted").dropDuplicates(["id", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2_000_000):
                picked, found, data_of = [], [], []
                for row, (text, spans_) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    data = code(text)
                    for span in spans_:
                        picked.append(row)
                        found.append(span)
                        data_of.append(data[span["start"] : span["start"] + span["n"] + length - 1])
                taken = pa.array(picked, pa.int64())
                kinds = {"start": pa.int64(), "n": pa.int32(), "anchor": pa.int64(), "block": pa.int64(), "big": pa.bool_(), "alone": pa.bool_()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken),
                     *(pa.array([f[c] for f in found], t) for c, t in kinds.items()), pa.array(data_of, pa.binary())],
                    names=["id", "th", *kinds, "data"],
                )

    return met.mapInArrow(
        freed(cut, owner_of(code)), f"id {kind}, th long, start long, n int, anchor long, block long, big boolean, alone boolean, data binary"
    )


MARK_SCHEMA = "id {kind}, th long, begin long, n long"


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of consecutive numbers."""
    if not len(places):
        return []
    turns = np.nonzero(np.diff(places) != 1)[0] + 1
    firsts = np.concatenate([[0], turns])
    return list(zip(places[firsts].tolist(), np.diff(np.concatenate([firsts, [len(places)]])).tolist()))


def indexed_marks(block_rows: DataFrame, length: int) -> DataFrame:
    """Windows that a block's index finds twice, as runs of starts: id, th, begin, n."""
    kind = block_rows.schema["id"].dataType.simpleString()

    def mark(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        found = RunIndex(block.column("data").to_pylist()).repeated(length)
        alone, starts = block.column("alone").to_pylist(), block.column("start").to_pylist()
        out = [(row, starts[row] + first, n) for row, hits in enumerate(found) if alone[row] for first, n in runs(hits)]
        taken = pa.array([o[0] for o in out], pa.int64())
        return pa.table({
            "id": block.column("id").take(taken), "th": block.column("th").take(taken),
            "begin": pa.array([o[1] for o in out], pa.int64()), "n": pa.array([o[2] for o in out], pa.int64()),
        })

    return block_rows.groupBy("block").applyInArrow(freed_group(mark), MARK_SCHEMA.format(kind=kind))


def window_marks(big_rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors beyond a block: windows with equal digests, counted by Spark."""
    kind = big_rows.schema["id"].dataType.simpleString()

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 8, 100_000):
                picked, begins, digests = [], [], []
                for row, (data, start) in enumerate(zip(batch.column(8).to_pylist(), batch.column(2).to_pylist())):
                    view = memoryview(data)
                    for at in range(len(data) - length + 1):
                        picked.append(row)
                        begins.append(start + at)
                        digests.append(xxhash.xxh3_128_digest(view[at : at + length]))
                taken = pa.array(picked, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), batch.column(7).take(taken),
                     pa.array(begins, pa.int64()), pa.array(digests, pa.binary())],
                    names=["id", "th", "alone", "begin", "digest"],
                )

    listed = big_rows.mapInArrow(freed(list_windows), f"id {kind}, th long, alone boolean, begin long, digest binary")
    twice = listed.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    return listed.where("alone").join(twice, "digest", "left_semi").select("id", "th", "begin", F.lit(1).cast("long").alias("n"))


def marks_of(rows: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, *, code: Code = as_bytes) -> DataFrame:
    """Runs of window starts whose bytes also start anywhere else: id, th, begin, n. Rows: id, th, text."""
    listed = written(spans(rows, length, code), "spans")
    # Written first: a join of two plain exchanges is one that Spark splits where an anchor is frequent.
    anchors = written(listed.groupBy("anchor").agg(
        F.count("*").alias("times"), F.min("digest").alias("a"), F.max("digest").alias("b")
    ).where("times > 1").select("anchor", F.expr("a <> b").alias("mixed")), "shared-anchors")
    shared = written(listed.join(anchors, "anchor"), "shared-spans")
    alike = shared.where("NOT mixed").select("id", "th", F.col("start").alias("begin"), F.col("n").cast("long").alias("n"))
    groups = written(
        shared.where("mixed").groupBy("anchor", "digest").agg(
            F.count("*").alias("times"), F.min(F.struct("id", "th", "start", "n")).alias("rep")
        ),
        "span-groups",
    )
    copies = groups.where("times > 1").select("anchor", "digest")
    copied = shared.where("mixed").join(copies, ["anchor", "digest"], "left_semi").select(
        "id", "th", F.col("start").alias("begin"), F.col("n").cast("long").alias("n")
    )
    weights = groups.groupBy("anchor").agg(F.sum(F.expr(f"rep.n + {length - 1}")).alias("weight"))
    usual = f"CASE WHEN weight <= {block_bytes} THEN weight ELSE 0 END"
    blocks = weights.select(F.expr(f"CAST(coalesce(sum({usual}), 0) div {block_bytes} + 1 AS BIGINT)")).scalar()
    placed = groups.join(weights, "anchor").select(
        "rep.*", "anchor", F.pmod(F.xxhash64("anchor"), blocks).alias("block"),
        F.expr(f"weight > {block_bytes}").alias("big"), F.expr("times = 1").alias("alone"),
    )
    data = written(with_bytes(placed, rows, length, code), "span-bytes")
    return alike.unionAll(copied).unionAll(indexed_marks(data.where("NOT big"), length)).unionAll(
        window_marks(data.where("big"), length)
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def with_ranges(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (id, th, text, ...) with `ranges`, their marked runs of starts in order."""
    ranges = marks.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("begin", "n"))).alias("ranges"))
    return same_document(rows, ranges, "left")


def removed(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (from, to) covered by the marked windows."""
    out: list[tuple[int, int]] = []
    for mark in ranges or ():
        begin, end = mark["begin"], mark["begin"] + mark["n"] + length - 1
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def removed_words(ranges: list[dict] | None, words: int, data: bytes) -> list[tuple[int, int]]:
    """The same for marks of coded words: byte ranges from the first to the last word."""
    aligned = []
    for mark in ranges or ():
        first, last = -(-mark["begin"] // WORD_BYTES), (mark["begin"] + mark["n"] - 1) // WORD_BYTES
        if last >= first:
            aligned.append({"begin": first, "n": last - first + 1})
    if not aligned:
        return []
    places = [found.span() for found in WORD.finditer(data)]
    return [(places[begin][0], places[end - 1][1]) for begin, end in removed(aligned, words)]


def cut_rows(rows: DataFrame, carried: str, length: int, words: int | None = None) -> DataFrame:
    """Cut the texts of rows (id, th, text, and the column `carried`): carried, n_bytes, ..., kept_text."""
    if words is not None and words < LEAST_WORDS:
        raise ValueError(f"a passage needs {LEAST_WORDS} words at least")
    plain = rows.select("id", "th", "text")
    marks = marks_of(plain, length) if words is None else marks_of(plain, words * WORD_BYTES, code=as_words)
    met = with_ranges(rows, marks).select(carried, F.col("text").alias("cut_text"), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                out = []
                for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    data, at, kept = text.encode(), 0, []
                    gone = removed(ranges, length) if words is None else removed_words(ranges, words, data)
                    for begin, end in gone:
                        kept.append(data[at:begin])
                        at = end
                    kept.append(data[at:])
                    left = b"".join(kept)
                    out.append((
                        len(data), len(data) - len(left), len(gone), sha256(left).hexdigest(),
                        "".join(part.decode("utf-8", "ignore") for part in kept),
                    ))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))],
                    names=[carried, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    kind = met.schema[carried].dataType.simpleString()
    return met.mapInArrow(
        freed(cut), f"{carried} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, one row per input row."""
    return cut_rows(keyed(docs, id_col, text_col), "id", length).withColumnRenamed("id", id_col)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int | None = None
) -> DataFrame:
    """The rows with their own columns, repeated passages cut out of the text. A null text stays null.

    With `words`, passages of so many words and more count, whatever bytes they have.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = "none"
    while none in docs.columns:
        none += "_"
    row = F.struct(F.col(f"`{text_col}`").isNull().alias(none), *[F.col(f"`{c}`") for c in others])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), row.alias("row"))
    done = cut_rows(rows, "row", length, words)
    kept = F.when(~F.col("row")[none], F.col("kept_text"))
    return done.select(*[
        kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
    ])


def run_query(docs: DataFrame) -> DataFrame:
    return cut_documents(only(docs, "doc_id", "text"))
