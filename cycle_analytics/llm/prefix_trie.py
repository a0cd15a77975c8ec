"""Prefix trie of conversations, from vertical bitmaps per shard.

A conversation is a path of turns; a turn counts by 128 bits of its role and text. A node is a distinct prefix.

1. Paths are sorted by (path, id) over range partitions. A path that a third of all conversations share is spread
   over many partitions this way, since ids divide it.
2. A sorted partition is read as a stream of shards of bounded size. A shard indexes (position, turn) to the bitset
   of its conversations and (length) to those that end there. Going down depth first, a node's bitset and a posting
   give a child; counts of bits give members, and ends are the bits that end at that depth. The lowest bit left names the
   next posting to try, so no posting is tried in vain.
3. All figures of a node add up over shards once it is clear who counts what neighbouring shards share: the prefix
   that the first path of a shard has in common with the path before it belongs to the earlier shard. These lengths
   are known inside a partition; for its two edges they come from one row per partition.
4. A node within one shard is finished there. Only nodes on a shard's edges (a path's length for each shard at most)
   are merged by key, and only children of those look their parent up.
5. Ids that end in an edge node leave the shards as joined text, one piece a shard, and are hashed as one stream in
   order, so a node that holds a third of all conversations takes the memory of one piece.

Rows without an id belong to no conversation. Turns are ordered by number, null first; equal numbers by what they
hold, so repeated rows are repeated turns. Null roles and texts are empty. Without rows there are no nodes. Long texts
count by their digest and their bytes only; the turns of one conversation are held in one row, 24 bytes a turn. Extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only
from cycle_analytics.session import written

TURN_BYTES = 16
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 32_768
NO_ENDS = sha256(b"").hexdigest()


def conversation_paths(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """id and steps: (digest, bytes of the text) of every turn in order."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    step = F.struct(
        F.col(f"`{turn_col}`").alias("turn"), F.unhex(F.md5(whole)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), step.alias("step"))
    ordered = F.array_sort(F.collect_list("step"))
    return rows.groupBy("id").agg(ordered.alias("steps")).select("id", F.transform("steps", lambda s: s.dropFields("turn")).alias("steps"))


def sorted_paths(paths: DataFrame) -> DataFrame:
    """pid, id, path, sizes, written in order of (path, id); pid ascends with it."""
    flat = paths.select(
        "id", F.unhex(F.array_join(F.transform("steps", lambda s: F.hex(s["digest"])), "")).alias("path"),
        F.transform("steps", lambda s: s["size"]).alias("sizes"),
    )
    placed = flat.repartitionByRange("path", "id").select(F.spark_partition_id().alias("pid"), "id", "path", "sizes")
    return written(placed, "sorted-paths")


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """How many first turns two paths share; -1 where there is no path."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // TURN_BYTES
    if a[: n * TURN_BYTES] == b[: n * TURN_BYTES]:
        return n
    x, y = (np.frombuffer(p, np.uint8, n * TURN_BYTES) for p in (a, b))
    return int(np.argmax(x != y)) // TURN_BYTES


class Shard:
    """The bitmaps of consecutive conversations and the nodes they give.

    `before` and `after` are the turns that its first and last path share with their neighbours outside.
    """

    def __init__(self, ids: list[int], paths: list[bytes], sizes: list[list[int]], before: int, after: int):
        self.ids, self.sizes, self.before, self.after = ids, sizes, before, after
        self.steps = [[p[k : k + TURN_BYTES] for k in range(0, len(p), TURN_BYTES)] for p in paths]
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, int] = {}
        for k, steps in enumerate(self.steps):
            bit = 1 << k
            self.ends[len(steps)] = self.ends.get(len(steps), 0) | bit
            for at in enumerate(steps):
                self.postings[at] = self.postings.get(at, 0) | bit

    def children(self, members: int, depth: int) -> Iterator[int]:
        """The bitsets of a node's children."""
        left = members & ~self.ends.get(depth, 0)
        while left:
            lowest = (left & -left).bit_length() - 1
            child = left & self.postings[depth, self.steps[lowest][depth]]
            yield child
            left ^= child

    def nodes(self) -> dict[str, list]:
        """Every node, parents first: parent, depth, members, spans, child, leaf, saved, ended ids, lowest id, a member."""
        last = len(self.ids) - 1
        parent, depth, count, spans, own, saved, ended, member = ([] for _ in range(8))
        todo = [(-1, 0, (1 << len(self.ids)) - 1)]
        while todo:
            up, d, bits = todo.pop()
            here = len(parent)
            low = (bits & -bits).bit_length() - 1
            shares_before = low == 0 and d <= self.before
            shares_after = bool(bits >> last) and d <= self.after
            n = bits.bit_count()
            here_ends, ends = [], bits & self.ends.get(d, 0)
            while ends:
                k = (ends & -ends).bit_length() - 1
                here_ends.append(self.ids[k])
                ends &= ends - 1
            parent.append(up)
            depth.append(d)
            count.append(n)
            spans.append(shares_before or shares_after)
            own.append(0 if shares_before else 1)
            saved.append((n - (not shares_before)) * self.sizes[low][d - 1] if d else 0)
            ended.append(here_ends)
            member.append(low)
            if len(here_ends) < n:
                todo += [(here, d + 1, child) for child in self.children(bits, d)]
        children, leaves, lowest = [0] * len(parent), [0] * len(parent), [min(e, default=None) for e in ended]
        for k in range(len(parent) - 1, -1, -1):
            # A leaf on the last path is left to the shard that goes on with that path.
            if count[k] == len(ended[k]) and not (spans[k] and self.goes_on(member[k], count[k], depth[k])):
                leaves[k] = 1
            up = parent[k]
            if up >= 0:
                children[up] += own[k]
                leaves[up] += leaves[k]
                saved[up] += saved[k]
                if lowest[up] is None or lowest[k] < lowest[up]:
                    lowest[up] = lowest[k]
        return {
            "parent": parent, "depth": depth, "n_convs": count, "spans": spans, "n_children": children,
            "n_leaves": leaves, "saved_tokens": saved, "ended": ended, "conv_id": lowest, "member": member,
        }

    def goes_on(self, low: int, n: int, depth: int) -> bool:
        return low + n == len(self.ids) and depth <= self.after

    def edge_keys(self) -> dict[tuple[int, int], str]:
        """Keys of the prefixes of the first and of the last path, by (path, depth)."""
        keys = {}
        for k, deepest in ((0, self.before), (len(self.ids) - 1, self.after)):
            told = sha256()
            for d in range(deepest + 1):
                if d:
                    told.update(self.steps[k][d - 1])
                keys[k, d] = told.hexdigest()
        return keys


NODE = (
    "shard long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "parent_conv_id long, ends_sha256 string, key string, parent_key string, ended string"
)
FIGURES = ["n_children", "n_leaves", "saved_tokens", "n_convs"]


def joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def node_rows(shard: Shard, number: int) -> pa.RecordBatch:
    """The nodes of a shard. Nodes on its edges carry a key; children of those carry their parent's."""
    found, keys = shard.nodes(), shard.edge_keys()
    last = len(shard.ids) - 1
    members, depths, spans, ids = found["member"], found["depth"], found["spans"], found["conv_id"]
    own_key = [
        (keys.get((0, d)) if low == 0 and d <= shard.before else keys.get((last, d))) if edge else None
        for low, d, edge in zip(members, depths, spans)
    ]
    parents = found["parent"]
    parent_key = [own_key[up] if up >= 0 else None for up in parents]
    parent_id = [ids[up] if up >= 0 and own_key[up] is None else None for up in parents]
    hashes = [
        None if key else sha256(joined(e).encode()).hexdigest() if e else NO_ENDS for key, e in zip(own_key, found["ended"])
    ]
    pieces = [joined(e) if key and e else None for key, e in zip(own_key, found["ended"])]
    columns = {
        "shard": [number] * len(ids), "depth": depths, "conv_id": ids, "n_convs": found["n_convs"],
        "n_children": found["n_children"], "n_leaves": found["n_leaves"], "saved_tokens": found["saved_tokens"],
        "parent_conv_id": parent_id, "ends_sha256": hashes, "key": own_key, "parent_key": parent_key, "ended": pieces,
    }
    text = {"ends_sha256", "key", "parent_key", "ended"}
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.string() if c in text else pa.int64()) for c, v in columns.items()], names=list(columns)
    )


def edges(rows: DataFrame) -> DataFrame:
    """pid, before, after: the paths next to each partition. One row a partition, whatever the input is."""
    ends = rows.groupBy("pid").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("pid")
    return ends.select("pid", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))


def shard_nodes(rows: DataFrame, max_conversations: int, max_turns: int) -> DataFrame:
    """Node rows (NODE) of every shard of the sorted paths."""
    told = rows.join(edges(rows), "pid").select("pid", "path", "id", "sizes", "before", "after")
    lined = told.repartition("pid").sortWithinPartitions("pid", "path", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_turns, number, pid, previous, beyond = 0, 0, None, None, None

        def close(following: bytes | None) -> pa.RecordBatch:
            before = shared_turns(previous, held[0][0])
            after = shared_turns(held[-1][0], following)
            paths, ids, sizes = zip(*held)
            return node_rows(Shard(list(ids), list(paths), list(sizes), before, after), (pid << 32) + number)

        for batch in batches:
            for row_pid, path, conv, sizes, before, after in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if held and (row_pid != pid or len(held) == max_conversations or held_turns + len(sizes) > max_turns):
                    yield close(path if row_pid == pid else beyond)
                    previous, held, held_turns, number = held[-1][0], [], 0, number + 1
                if row_pid != pid:
                    pid, previous, beyond, number = row_pid, before, after, 0
                held.append((path, conv, sizes))
                held_turns += len(sizes)
        if held:
            yield close(beyond)

    return lined.mapInArrow(cut, NODE)


def stream_hashes(pieces: DataFrame) -> DataFrame:
    """key, ends_sha256 of text pieces (key, shard, ended), which are joined by commas in order of their shards."""
    lined = pieces.repartition("key").sortWithinPartitions("key", "shard").select("key", "ended")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        hashes.append(told.hexdigest())
                    now, told = key, sha256()
                else:
                    told.update(b",")
                told.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([told.hexdigest()])], names=["key", "ends_sha256"])

    return lined.mapInArrow(run, "key string, ends_sha256 string")


def trie_of(paths: DataFrame, max_conversations: int = SHARD_CONVERSATIONS, max_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of conversations (id, steps)."""
    rows = sorted_paths(paths)
    nodes = written(shard_nodes(rows, max_conversations, max_turns), "trie-nodes")
    edge = nodes.where("key IS NOT NULL")
    merged = edge.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in FIGURES],
    )
    merged = written(merged, "trie-edges")
    hashed = stream_hashes(edge.where("ended IS NOT NULL"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    on_edges = merged.join(parents, "parent_key", "left").join(hashed, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))
    )
    inner = nodes.where("key IS NULL")
    # By (shard, key): a parent with very many children has no more of them in a shard than that holds.
    local = edge.select("shard", "key").join(merged.select("key", F.col("conv_id").alias("found")), "key").select(
        "shard", F.col("key").alias("parent_key"), "found"
    )
    below = inner.where("parent_key IS NOT NULL").join(local, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("found"))
    out = ["conv_id", "depth", "parent_conv_id", *FIGURES, "ends_sha256"]
    return inner.where("parent_key IS NULL").select(out).unionAll(below.select(out)).unionAll(on_edges.select(out))


def prefix_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row a node of the conversations as they are."""
    return trie_of(conversation_paths(turns, id_col, turn_col, role_col, text_col))


def grafted(paths: DataFrame, group: int = 5, longest: int = 9) -> DataFrame:
    """The query's conversations: each takes the first turns of the first one of its group, then its own after those."""
    first = F.col("id") - F.col("id") % group
    # Groups lie together, so the meeting needs no exchange of its own.
    grouped = paths.withColumn("top", first).repartition("top")
    tops = grouped.where("id = top").select("top", F.slice("steps", 1, longest - 1).alias("top_steps"))
    h = (F.crc32(F.col("id").cast("string")) % longest).cast("int")
    none = F.slice("steps", 1, 0)
    head = F.slice(F.coalesce("top_steps", none), F.lit(1), h)
    rest = F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))
    return grouped.join(tops, "top", "left").select("id", F.concat(head, rest).alias("steps"))


def run_query(conversations: DataFrame) -> DataFrame:
    rows = only(conversations, "conv_id", "turn", "role", "text")
    return trie_of(grafted(conversation_paths(rows, "conv_id", "turn", "role", "text")))
