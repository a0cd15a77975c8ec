"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Every source is a queue of tokens. In each round a source may hand over its share of one window; what whole
tokens cannot express is its deficit, which it carries into the next round. After r rounds a queue has handed
over floor(r * weight * window / UNIT) tokens, or all it has, so any worker can tell from the round alone what
a queue owes: deficits carry across windows and partitions without a running state. The rounds, laid end to
end, are cut into windows; a queue that has run dry leaves its room to the others.

1. One pass encodes the texts and writes ids with each document's place in its partition's part of the queue.
2. Totals per partition and source (few rows) give the start of each part, and the rounds of each queue.
3. Running sums over rounds, in three levels of 1,024, place every round's tokens in the stream.
4. Documents are cut at round borders, joined with their (source, round) - never more than one round's tokens
   under one key, however large a source is - and cut again where windows end.

Only the last window may be short; it is the only one with padding. Null and empty texts are the end id alone.
A null source is a queue of its own. Repeated rows are packed once each. Empty tables give no pieces.
Extra columns are left alone.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cycle_analytics.llm.common import freed, only, remembers, slices
from cycle_analytics.session import written

WINDOW = 4096
UNIT = 65536
END_ID = 2
LEVEL = 1024
CACHED_CHUNKS = 800_000
# Texts that are divided into chunks at once: the arrays made of them are many times as large, beside what is remembered.
SLICE_BYTES = 4_000_000
# What the vocabulary's own rule takes as one word.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
# With these in it, or with characters beyond the usual ones, the library sees the whole text.
SPECIAL = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
# By byte: blanks as one kind of blank; letters; signs that never begin a word with letters in it.
ONE_BLANK = np.arange(256, dtype=np.uint8)
ONE_BLANK[list(b"\t\n\x0b\x0c\r")] = ord(" ")
IS_LETTER, IS_SIGN = np.zeros(256, bool), np.zeros(256, bool)
IS_LETTER[list(string.ascii_letters.encode())] = True
IS_SIGN[list(string.punctuation.replace("'", "").encode())] = True
UNUSUAL = re.compile(r"[^\x00-\xff\u2010-\u2027\u20ac]")


def is_usual(text: str) -> bool:
    """Whether blanks and words are told apart here as the library does. Most texts are decided without a pattern."""
    if any(part in text for part in SPECIAL):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not UNUSUAL.search(text)


def chunked(texts: list[str]) -> pa.ListArray:
    """What stands between the blanks of usual texts, in lower case; two blanks have an empty chunk between them.

    Letters and the signs beside them are chunks of their own: no word of the vocabulary's rule holds both, unless the
    sign is an apostrophe.
    """
    lines = pc.utf8_lower(pa.array(texts, pa.large_string()))
    _, ends, data = lines.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[: ends[-1]]
    whole = ONE_BLANK[data]
    latin = np.flatnonzero(data[:-1] >= 0xC2)
    first, second = data[latin], data[latin + 1]
    for place in latin[(first == 0xC2) & ((second == 0x85) | (second == 0xA0))]:
        whole[place : place + 2] = ord(" ")
    begun, ended, sign = IS_LETTER[data], IS_LETTER[data], IS_SIGN[data]
    marked = latin[(first == 0xC3) & (second != 0x97) & (second != 0xB7)]
    begun[marked] = ended[marked + 1] = True
    places = np.flatnonzero((ended[:-1] & sign[1:]) | (sign[:-1] & begun[1:])) + 1
    parted = np.insert(whole, places, ord(" "))
    begins = ends + np.searchsorted(places, ends)
    return pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(begins), pa.py_buffer(parted)), " ")


class Encoder:
    """Ids of whole texts. No word crosses a blank, so what stands between blanks is looked up if it was seen before.

    Each chunk is looked up once for all texts of a call. What they bring anew goes to the library in a few calls, and its
    ids are told apart by the ids that end words. Words of letters alone are no question of its pattern, nor of its normal
    form, so they go to copies that divide at blanks only.
    Of two generations of remembered chunks the older one is dropped when the younger one is full.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain, self.lettered = (Tokenizer.from_file(path) for _ in range(3))
        self.plain.normalizer = self.lettered.normalizer = normalizers.Sequence([])
        at_blanks = pre_tokenizers.WhitespaceSplit()
        self.plain.pre_tokenizer = at_blanks
        self.lettered.pre_tokenizer = pre_tokenizers.Sequence(
            [at_blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True

    def direct(self, text: str) -> np.ndarray:
        if is_usual(text) and text.replace(" ", "").isalpha():
            maker, text = self.plain if text.isascii() else self.lettered, text.lower()
        else:
            maker = self.tokenizer
        return np.array(maker.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks."""
        kinds = [2 * chunk.isalpha() + chunk.isascii() for chunk in chunks]
        found = [iter(self.looked_up([c for c, k in zip(chunks, kinds) if k == kind])) for kind in range(4)]
        return [next(found[kind]) for kind in kinds]

    def looked_up(self, chunks: list[str]) -> list[bytes]:
        """Ids by the library."""
        if not chunks:
            return []
        ids = self.direct(" ".join(chunks))
        stops = np.flatnonzero(self.ends[ids]) + 1
        words = np.cumsum([1 if chunk.isalpha() else len(WORDS.findall(chunk)) for chunk in chunks])
        if not len(stops) or len(stops) != words[-1] or stops[-1] != len(ids):
            return [self.direct(chunk).tobytes() for chunk in chunks]
        width, whole = ids.itemsize, ids.tobytes()
        # The empty chunk has no word, wherever it stands.
        cuts = [0, *(np.concatenate([[0], stops])[words] * width).tolist()]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def remembered(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, known ones and new ones."""
        found = list(map(self.known.get, chunks))
        places = [k for k, ids in enumerate(found) if ids is None]
        if places:
            missing = [chunks[k] for k in places]
            again = list(map(self.older.get, missing))
            learned = iter(self.learn([c for c, ids in zip(missing, again) if ids is None]))
            if len(self.known) >= CACHED_CHUNKS:
                self.known, self.older = {}, self.known
            for k, chunk, ids in zip(places, missing, again):
                found[k] = ids = next(learned) if ids is None else ids
                if len(chunk) <= 64:
                    self.known[chunk] = ids
        return found

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        usual = [text != "" and is_usual(text) for text in texts]
        out = [b"" if known or not text else self.direct(text).tobytes() for text, known in zip(texts, usual)]
        places = [k for k, known in enumerate(usual) if known]
        if places:
            chunks = chunked([texts[k] for k in places])
            coded = chunks.flatten().dictionary_encode()
            different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = pa.array(self.remembered(different), pa.large_binary()).take(coded.indices)
            _, ends, whole = ids.buffers()
            cuts = np.frombuffer(ends, np.int64)[chunks.offsets.to_numpy()].tolist()
            for k, a, b in zip(places, cuts, cuts[1:]):
                out[k] = whole[a:b].to_pybytes()
        return out

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


remembers("packing", encoder.cache_clear)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queue_name(column: str) -> Column:
    """The name of a source's queue; the null source has the empty name."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def encoded(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """Queue parts: part, queue, id, start (tokens before it in this part of the queue), n, ids."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, held = encoder(vocabulary), {}
        end = np.array([end_id], maker.kind).tobytes()
        width = len(end)
        for whole in batches:
            for batch in slices(whole, 3, SLICE_BYTES):
                queues = batch.column(1).to_pylist()
                ids = [found + end for found in maker.all_ids([t or "" for t in batch.column(3).to_pylist()])]
                starts = []
                for queue, found in zip(queues, ids):
                    starts.append(held.get(queue, 0))
                    held[queue] = starts[-1] + len(found) // width
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(starts, pa.int64()),
                     pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([width] * len(ids), pa.int32())],
                    names=["part", "queue", "id", "start", "n", "ids", "width"],
                )

    frame = docs.select(
        F.spark_partition_id().alias("part"),
        queue_name(source_col).alias("queue"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(
        freed(solve, "packing"), f"part int, queue string, id {kind}, start long, n long, ids binary, width int"
    )


def handed_over(round_: str, window: int) -> Column:
    """Tokens a queue may have handed over before a round: floor(round * weight * window / UNIT), without overflow."""
    return F.expr(
        f"({round_} div {UNIT}) * weight * {window} + (({round_} % {UNIT}) * weight * {window}) div {UNIT}"
    )


def queues_of(parts: DataFrame, targets: DataFrame | None, window: int) -> DataFrame:
    """Each queue's tokens, weight in units of 1/65,536 of a window, and last round.

    The weight is the queue's share of all tokens unless `targets` (source, weight) says otherwise.
    """
    sums = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    if targets is None:
        weighed = sums.withColumn("wanted", F.col("total").cast("double"))
    else:
        wanted = targets.select(queue_name("source").alias("queue"), F.col("weight").cast("double").alias("w"))
        wanted = wanted.groupBy("queue").agg(F.sum("w").alias("w"))
        weighed = sums.join(wanted, "queue", "left").withColumn("wanted", F.coalesce("w", F.lit(0.0))).drop("w")
    whole = weighed.select(F.sum("wanted")).scalar()
    share = F.coalesce(F.try_divide(F.col("wanted"), whole), F.lit(0.0))
    weight = F.greatest(F.lit(1), F.round(share * UNIT)).cast("long")
    return weighed.select("queue", "total", weight.alias("weight")).withColumn(
        "last", F.expr(f"(total * {UNIT} + weight * {window} - 1) div (weight * {window}) - 1")
    )


def running(rows: DataFrame, key: str, value: str, levels: int = 3) -> DataFrame:
    """Sum of `value` over all smaller keys, for every key from 0 on. Rows meet in blocks of 1,024 keys, level by level."""
    block = f"{key}_block"  # another name on each level: a block is the key of the level above
    sums = rows.groupBy(key).agg(F.sum(value).alias(value))
    blocked = sums.withColumn(block, F.expr(f"{key} div {LEVEL}") if levels else F.lit(0).cast("long"))
    above = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("before", F.coalesce(F.sum(value).over(above), F.lit(0)))
    if not levels:
        return inside.select(key, "before")
    upper = running(blocked.select(block, value), block, value, levels - 1).withColumnRenamed("before", "base")
    return inside.join(upper.hint("merge"), block).select(key, (F.col("before") + F.col("base")).alias("before"))


def rounds_of(queues: DataFrame, window: int) -> DataFrame:
    """What each queue hands over in each round: queue, round, first (place in the queue), held (tokens)."""
    level = LEVEL * LEVEL
    spread = (
        queues.withColumn("top", F.explode(F.expr(f"sequence(0L, last div {level})")))
        .withColumn("mid", F.explode(F.expr(f"sequence(0L, {LEVEL - 1}L)")))
        .withColumn("base", F.col("top") * level + F.col("mid") * LEVEL)
        .where("base <= last").repartition("queue", "base")
    )
    rounds = spread.withColumn("round", F.explode(F.expr(f"sequence(base, least(last, base + {LEVEL - 1}))")))
    sized = rounds.withColumn("first", F.least("total", handed_over("round", window))).withColumn(
        "held", F.least("total", handed_over("(round + 1)", window)) - F.col("first")
    )
    return sized.where("held > 0").select("queue", "round", "first", "held")


def placed(rounds: DataFrame, window: int) -> DataFrame:
    """Where the rounds' tokens lie: queue, round, first, held, sequence_id, offset; cut where windows end.

    Spark sizes rounds by the few queues they are made of, so joins that grow with them are told to merge, not to broadcast.
    """
    sums = written(rounds.groupBy("round").agg(F.sum("held").alias("held")), "packing-rounds")
    beside = Window.partitionBy("round").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    inside = rounds.withColumn("inside", F.coalesce(F.sum("held").over(beside), F.lit(0)))
    before = running(sums, "round", "held").hint("merge")
    at = inside.join(before, "round").withColumn("at", F.col("before") + F.col("inside"))
    cut = at.withColumn(
        "sequence_id", F.explode(F.expr(f"sequence(at div {window}, (at + held - 1) div {window})"))
    ).withColumn("begin", F.greatest("at", F.col("sequence_id") * window))
    finish = F.least(F.col("at") + F.col("held"), (F.col("sequence_id") + 1) * window)
    return cut.select(
        "queue", "round", (F.col("first") + F.col("begin") - F.col("at")).alias("first"),
        (finish - F.col("begin")).alias("held"), "sequence_id",
        (F.col("begin") - F.col("sequence_id") * window).alias("offset"),
    )


def cut_documents(parts: DataFrame, queues: DataFrame, window: int, kind: str) -> DataFrame:
    """Documents cut at round borders: queue, round, id, first (place in the queue), start, n, doc_tokens, ids, width (bytes of an id)."""
    sums = parts.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carry"))
    # Of a written frame Spark knows the size before it plans the join, and shuffles no ids for a small one.
    rated = written(carried.join(queues.select("queue", "weight"), "queue"), "packing-parts")
    rows = parts.join(rated, ["part", "queue"]).select(
        "queue", "id", (F.col("carry") + F.col("start")).alias("first"), "n", "weight", "width", "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 6):
                picked, out = [], {name: [] for name in ("round", "first", "start", "n", "doc_tokens", "ids")}
                columns = [batch.column(k).to_pylist() for k in range(2, 7)]
                for row, (first, n, weight, width, ids) in enumerate(zip(*columns)):
                    rate = weight * window
                    low, high = -(-(first + 1) * UNIT // rate) - 1, -(-(first + n) * UNIT // rate) - 1
                    borders = sorted({(r * rate) // UNIT for r in range(low + 1, high + 1)}) if high > low else []
                    begin = first
                    for stop in [*(b for b in borders if first < b < first + n), first + n]:
                        picked.append(row)
                        out["round"].append(-(-(begin + 1) * UNIT // rate) - 1)
                        out["first"].append(begin)
                        out["start"].append(begin - first)
                        out["n"].append(stop - begin)
                        out["doc_tokens"].append(n)
                        out["ids"].append(ids[(begin - first) * width : (stop - first) * width])
                        begin = stop
                rows_taken = pa.array(picked, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows_taken), batch.column(1).take(rows_taken),
                     *(pa.array(out[c], pa.int64()) for c in ("round", "first", "start", "n", "doc_tokens")),
                     pa.array(out["ids"], pa.binary()), batch.column(5).take(rows_taken)],
                    names=["queue", "id", "round", "first", "start", "n", "doc_tokens", "ids", "width"],
                )

    return rows.mapInArrow(
        freed(cut), f"queue string, id {kind}, round long, first long, start long, n long, doc_tokens long, ids binary, width int"
    )


def widened(pieces: DataFrame) -> DataFrame:
    """`token_ids` as little-endian unsigned 32-bit numbers; `width` goes."""
    place, kept = pieces.columns.index("token_ids"), [k for k, c in enumerate(pieces.columns) if c != "width"]

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [
                np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                for ids, width in zip(batch.column("token_ids").to_pylist(), batch.column("width").to_pylist())
            ]
            yield batch.set_column(place, "token_ids", pa.array(wide, pa.binary())).select(kept)

    return pieces.mapInArrow(freed(widen), pieces.drop("width").schema)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    targets: DataFrame | None = None, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None,
) -> DataFrame:
    """Pack all documents into windows. One row per piece:

    id, start, length, token_ids (little-endian unsigned 32-bit), doc_tokens, source_queue, sequence_id, offset.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = written(
        encoded(docs, id_col, text_col, source_col, vocabulary or default_vocabulary(), end_id), "packing-ids"
    )
    queues = written(queues_of(parts, targets, window), "packing-queues")
    laid = placed(rounds_of(queues, window), window).select(
        "queue", "round", F.col("first").alias("seg_first"), F.col("held").alias("seg_held"), "sequence_id", "offset"
    )
    cut = cut_documents(parts, queues, window, kind)
    low = F.greatest("first", "seg_first")
    met = cut.join(laid.hint("merge"), ["queue", "round"]).withColumn("low", low).withColumn(
        "length", F.least(F.col("first") + F.col("n"), F.col("seg_first") + F.col("seg_held")) - F.col("low")
    ).where("length > 0")
    return widened(met.select(
        F.col("id").alias(id_col), (F.col("start") + F.col("low") - F.col("first")).alias("start"), "length",
        F.expr("substring(ids, int(width * (low - first) + 1), int(width * length))").alias("token_ids"), "doc_tokens",
        F.expr("substring(queue, 2)").alias("source_queue"), "sequence_id",
        (F.col("offset") + F.col("low") - F.col("seg_first")).alias("offset"), "width",
    ))


def run_query(docs: DataFrame) -> DataFrame:
    pieces = pack(only(docs, "doc_id", "text", "source"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
