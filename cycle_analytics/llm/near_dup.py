"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find grouping.

A shingle draws a random permutation of the slots and one random number per rank; slot values are rank plus
number, and the smallest per slot is kept. Ranks of one shingle are correlated - it takes every slot at another
rank - which lowers the variance against independent hashing, and a text stops at the rank that can no longer
lower any slot. Texts of a batch go through the ranks together.

1. Texts with equal shingle sets are one class, however many there are; a class is represented by its smallest id.
2. Classes that share a band of signature values meet in a bucket. A bucket never forms its pairs: its members
   are compared with one pivot. Links found so far are united, and only buckets that still hold several
   components go on, to an exact way for the rest. Buckets of up to 8 give their open
   pairs; larger ones are compared in blocks, inside tasks, by sampled shingle sets, and give possible links only.
3. Links are confirmed on full shingle sets: 100 * intersection >= percent * union. Pairs whose sizes or signatures
   rule that out are not fetched; the signature test lets pairs pass that are five standard deviations lower.

With the default 32 bands of 4 values a pair at the threshold of 0.8 is missed with probability 5e-8.

Null, empty and blank texts have no shingles; each is its own component and is kept. A text with fewer words than
a shingle is one shingle. In `near_duplicates` a row has the component of its own text's class, a null id is linked
with nothing and kept, and repeated rows have one component and the same verdict. `keep_one` judges row by row under
keys of its own, whatever the ids are. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import freed, freed_group, only, remembers, slices
from cycle_analytics.llm.components import Forest, components
from cycle_analytics.session import written

SLOTS = 128
BANDS = 32
PERCENT = 80
PIVOT_ROUNDS = 1
SMALL_BUCKET = 8
SAMPLE = 512
CACHED_WORDS = 500_000
COLUMNS = 1024
STRIPE = 128
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31, S32, S56, S8 = (np.uint64(k) for k in (27, 30, 31, 32, 56, 8))
STEPS = np.arange(1, 257, dtype=np.uint64) * STEP

word_hashes: dict[bytes, int] = {}
remembers("near_dup", word_hashes.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> S30)) * MIX_A
    x = (x ^ (x >> S27)) * MIX_B
    return x ^ (x >> S31)


def hash_of(word: bytes) -> int:
    known = word_hashes.get(word)
    if known is None:
        if len(word_hashes) >= CACHED_WORDS:
            word_hashes.clear()
        known = word_hashes[word] = xxhash.xxh3_64_intdigest(word)
    return known


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(hash_of, found), np.uint64, len(found))
    width = min(words, len(one))
    folded = one[: len(one) - width + 1]
    for k in range(1, width):
        folded = mixed(folded * STEP + one[k : len(one) - width + 1 + k])
    return np.unique(folded)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values of some sets, one row each; rank in the top byte, the random number below."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    least = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for rank in range(slots):
        if not len(items):
            break
        drawn = mixed(items + STEPS[rank])
        place = rank + ((mixed(drawn) >> S32) * np.uint64(slots - rank) >> S32).astype(np.int64)
        if order is None and rank:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
            rows = np.arange(len(items))
            first = ((mixed(mixed(items + STEP)) >> S32) * np.uint64(slots) >> S32).astype(np.int64)
            order[rows, first] = 0
            order[rows, 0] = first
        if order is None:
            slot = place
        else:
            rows = np.arange(len(items))
            slot = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, rank]
        np.minimum.at(least, owner * slots + slot, (np.uint64(rank) << S56) | (drawn >> S8))
        open_ = least.reshape(-1, slots).max(1) >= (np.uint64(rank + 1) << S56) if rank + 1 < slots else None
        if open_ is None:
            break
        keep = open_[owner]
        if not keep.all():
            items, owner = items[keep], owner[keep]
            order = None if order is None else order[keep]
    return least.reshape(-1, slots)


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = values.reshape(len(values), bands, -1)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * STEP), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mixed(key * STEP + parts[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """id, n_shingles, set_digest, bands (keys), marks (one byte per slot); the last three null without shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1_000_000):
                sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
                values = signatures(sets)
                keys = band_keys(values, bands)
                marks = (mixed(values) & np.uint64(255)).astype(np.uint8)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full)], pa.binary()),
                        pa.array([k if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
                        pa.array([m.tobytes() if f else None for m, f in zip(marks, full)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_digest", "bands", "marks"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        freed(sketch, "near_dup"), f"id {kind}, n_shingles long, set_digest binary, bands array<long>, marks binary"
    )


def likely(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Pairs (low, high) whose sizes and signatures leave a link possible."""
    a = cards.select(F.col("rep").alias("low"), F.col("n").alias("n_a"), F.col("marks").alias("m_a"))
    b = cards.select(F.col("rep").alias("high"), F.col("n").alias("n_b"), F.col("marks").alias("m_b"))
    sized = pairs.join(a, "low").join(b, "high").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    ).select("low", "high", "m_a", "m_b")
    share = percent / 100
    least = SLOTS * share - 5 * (SLOTS * share * (1 - share)) ** 0.5

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3)
            )
            fits = (a == b).sum(1) >= least
            yield batch.select([0, 1]).filter(pa.array(fits))

    kind = pairs.schema["low"].dataType.simpleString()
    return sized.mapInArrow(freed(test, "near_dup"), f"low {kind}, high {kind}")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    a = texts.select(F.col("id").alias("low"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("high"), F.col("text").alias("text_b"))
    both = pairs.join(a, "low").join(b, "high").select("low", "high", "text_a", "text_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[str, np.ndarray] = {}

        def set_of(text: str) -> np.ndarray:
            known = recent.get(text)
            if known is None:
                if len(recent) >= 200:
                    recent.clear()
                known = recent[text] = shingle_set(text, words)
            return known

        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = set_of(x), set_of(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    kind = pairs.schema["low"].dataType.simpleString()
    return both.mapInArrow(freed(test, "near_dup"), f"low {kind}, high {kind}")


def unresolved(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Bucket rows (key, rep, root) of the buckets that hold more than one component."""
    rooted = buckets.join(roots, buckets["rep"] == roots["node"], "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("root")
    )
    several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    return rooted.join(several.select("key"), "key", "left_semi")


def pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Every member of a bucket with the bucket's pivot of this turn, if they are in different components.

    The first pivot is the member that meets most others over all its buckets: the text that copies were made from.
    """
    order = -F.col("weight") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    drawn = F.struct(order.alias("draw"), F.col("rep").alias("p"), F.col("root").alias("p_root"))
    pivots = rows.groupBy("key").agg(F.min(drawn).alias("pivot")).select("key", "pivot.p", "pivot.p_root")
    return rows.join(pivots, "key").where("root <> p_root").select(
        F.least("rep", "p").alias("low"), F.greatest("rep", "p").alias("high")
    )


def small_bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most `SMALL_BUCKET` members."""
    small = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") <= SMALL_BUCKET).select("key")
    mine = rows.join(small, "key", "left_semi")
    other = mine.select("key", F.col("rep").alias("other"), F.col("root").alias("other_root"))
    return mine.join(other, "key").where("rep < other AND root <> other_root").select(
        F.col("rep").alias("low"), F.col("other").alias("high")
    )


def upper_halves(hashes: np.ndarray, level: int) -> np.ndarray:
    short = (mixed(hashes) >> S32).astype(np.uint32)
    return short[short < (1 << (32 - level))]


def samples(texts: DataFrame, words: int) -> DataFrame:
    """rep, n, level, sample: all shingle hashes in 64 bits (level 0, fewer than 512), or the upper halves of those
    below 2^(32 - level), of which there are about 512 at most.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
                levels = [max(0, (len(s) // SAMPLE).bit_length()) for s in sets]
                kept = [s if not v else upper_halves(s, v) for s, v in zip(sets, levels)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(levels, pa.int32()),
                     pa.array([k.tobytes() for k in kept], pa.binary())],
                    names=["rep", "n", "level", "sample"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(freed(draw, "near_dup"), f"rep {kind}, n long, level int, sample binary")


def sampled_pairs(mine: list[int], other: list[int], n: np.ndarray, level: int, sets: list[np.ndarray], percent: int):
    """Pairs (i, j) whose sampled sets leave a link possible; all pairs of the two lists by one matrix product.

    Level 0 holds whole sets, and its pairs are links.
    """
    rows = sorted({*mine, *other})
    place = {row: k for k, row in enumerate(rows)}
    cut = [
        sets[r] if level == 0 else upper_halves(sets[r], level) if sets[r].dtype == np.uint64
        else sets[r][sets[r] < (1 << (32 - level))] for r in rows
    ]
    values, column, times = np.unique(np.concatenate(cut), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cut])
    several = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[several], number[column[several]]
    common = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int((times > 1).sum()), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        dense = np.zeros((len(rows), COLUMNS), np.float32)
        dense[owner[here], column[here] - at] = 1
        common += dense @ dense.T
    size, sizes = np.array([len(c) for c in cut], np.float32), n[rows]
    a, b = np.array([place[m] for m in mine]), np.array([place[o] for o in other])
    out = []
    # Some rows at a time: what is derived from the matrix is several times its size.
    for at in range(0, len(a), STRIPE):
        some = a[at : at + STRIPE]
        shared = common[np.ix_(some, b)]
        union = size[some][:, None] + size[b][None, :] - shared
        if level == 0:
            fits = 100 * shared.astype(np.int64) >= percent * union.astype(np.int64)
        else:
            share = percent / 100
            fits = shared >= (share - 5 * np.sqrt(share * (1 - share) / np.maximum(union, 1))) * union
        x, y = sizes[some][:, None], sizes[b][None, :]
        fits &= np.minimum(x, y) * 100 >= np.maximum(x, y) * percent
        out.extend((mine[at + i], other[j]) for i, j in zip(*np.nonzero(fits)))
    return out


def large_bucket_pairs(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Possible links between different components in the larger buckets, without forming their pairs as rows.

    Members are dealt into blocks of about 1,024; a task sees two blocks and gives only pairs that their sampled
    shingle sets do not rule out. Of whole sets it gives links alone, and only those that unite what it has not
    united yet; a pair that is no link must unite nothing, or links after it would be lost.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SMALL_BUCKET)
    mine = rows.join(sizes, "key").withColumn("blocks", F.expr("(size + 1023) div 1024"))
    members = mine.select(F.col("rep").alias("id")).distinct()
    cards = written(samples(texts.join(members, "id", "left_semi"), words), "bucket-samples")
    dealt = mine.join(cards, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    paired = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    grouped = paired.select(
        "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "rep", "root", "n", "level", "sample",
    )

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep, root = block.column("rep").to_pylist(), block.column("root").to_pylist()
        side, levels = block.column("block").to_pylist(), np.array(block.column("level").to_pylist())
        n = np.array(block.column("n").to_pylist(), np.int64)
        sets = [np.frombuffer(s, np.uint32 if v else np.uint64) for s, v in zip(block.column("sample").to_pylist(), levels)]
        first, second = block.column("first")[0].as_py(), block.column("second")[0].as_py()
        forest, out = Forest(), []
        for level in sorted(set(levels.tolist())):
            near = [i for i in range(len(rep)) if levels[i] in (level, level - 1)]
            now = [i for i in near if levels[i] == level]
            found = sampled_pairs(now, near, n, int(level), sets, percent)
            for i, j in found:
                if root[i] == root[j] or {side[i], side[j]} != {first, second} or (levels[j] == level and i >= j):
                    continue
                if level == 0:
                    if forest.root(root[i]) == forest.root(root[j]):
                        continue
                    forest.unite(root[i], root[j])
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        kind = block.schema.field("rep").type
        return pa.table({"low": pa.array([o[0] for o in out], kind), "high": pa.array([o[1] for o in out], kind)})

    kind = texts.schema["id"].dataType.simpleString()
    return grouped.groupBy("key", "first", "second").applyInArrow(freed_group(compare), f"low {kind}, high {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT,
    bands: int = BANDS,
) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links), kept (whether that is the row's own id)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    drawn = written(sketches(rows, words, bands), "sketches")
    classes = written(
        drawn.where("set_digest IS NOT NULL AND id IS NOT NULL").groupBy("set_digest").agg(
            F.min("id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"),
            F.any_value("marks").alias("marks"),
        ),
        "classes",
    )
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = written(keyed.join(shared, "key"), "buckets")
    weights = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    rest = met.select("key", "rep", F.col("rep").alias("root"))
    texts = written(rows.join(weights.select(F.col("rep").alias("id")), "id", "left_semi"), "candidates")
    cards = classes.select("rep", "n", "marks")
    tested = None
    roots = met.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0)
    for turn in range(PIVOT_ROUNDS + 1):
        if turn:
            rest = written(unresolved(rest.drop("root"), roots), "open-buckets")
        if turn < PIVOT_ROUNDS:
            weighed = rest if turn else rest.join(weights, "rep")
            asked = likely(pivot_pairs(weighed, turn).distinct(), cards, percent)
        else:
            asked = likely(small_bucket_pairs(rest).distinct(), cards, percent).unionAll(
                large_bucket_pairs(rest, texts, words, percent)
            ).distinct()
        if tested is not None:
            asked = asked.join(tested, ["low", "high"], "left_anti")
        pairs = written(asked, "pairs")
        found = written(confirmed(pairs, texts, words, percent), "confirmed")
        tested = pairs if tested is None else tested.unionAll(pairs)
        if not found.isEmpty():
            # What is already united goes on as one link per member.
            roots = components(found.unionAll(roots.select(F.col("root").alias("low"), F.col("node").alias("high"))))
    placed = drawn.join(classes.select("set_digest", "rep"), "set_digest", "left").join(
        roots, F.col("rep") == F.col("node"), "left"
    )
    # A row goes with the class of its own text, also where rows with other texts share its id.
    component = F.coalesce("root", "rep", "id")
    return placed.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT,
    equal_rows: bool = True,
) -> DataFrame:
    """One row of each group, the one with the smallest id, with its own columns; a null id comes last.

    `equal_rows` keeps the rows with the same id and text as that row too. Rows without shingles all stay.
    """
    row_key = "_row"
    while row_key in docs.columns:
        row_key += "_"
    # Written, so that all readers see the same keys.
    keyed = written(docs.withColumn(row_key, F.monotonically_increasing_id()), "keyed-rows")
    judged = near_duplicates(keyed, row_key, text_col, words, percent).select(
        F.col(row_key).alias("row"), F.col("component_id").alias("component")
    )
    place = F.struct(
        F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(row_key).alias("row"),
    )
    places = keyed.select(F.col(row_key).alias("row"), place.alias("place"))
    placed = written(places.join(judged, "row").select("component", "place"), "group-rows")
    best = placed.groupBy("component").agg(F.min("place").alias("best"), F.count("*").alias("size")).where("size > 1")
    met = placed.join(written(best.select("component", "best"), "group-best"), "component")
    gone = met.where("place.row <> best.row")
    if equal_rows:
        gone = gone.where("NOT (place.id <=> best.id AND place.th = best.th)")
    gone = gone.select(F.col("place.row").alias("gone"))
    return keyed.join(gone, keyed[row_key] == gone["gone"], "left_anti").drop(row_key)


def run_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(only(docs, "doc_id", "text"), words=2)
