"""Prefix trie, line removal and periodic runs against brute force and odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cycle_analytics.llm import line_dedup, periodic_runs, prefix_trie

DOCS = "doc_id long, text string, id string, th int, key string, places string, runs int"
TURNS = "conv_id long, turn int, role string, text string, id int, steps int, pid int, key int, shard int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def runs_by_hand(words, least=6, power=4):
    n, found = len(words), []
    for q in range(1, n // power + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            length = end - start
            if length >= max(least, power * q) and not any(
                all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q)
            ):
                found.append((start, length, q))
            # The next stretch of this lag starts after the mismatch.
            start = end - q + 1
    return sorted(found)


def digests_by_hand(words):
    runs = runs_by_hand(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, milli, sha(told), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_scan_finds_the_runs_of_any_words():
    draw = random.Random(5)
    for turn in range(400):
        letters = "ab" if turn % 3 else "abcde"
        words = [draw.choice(letters) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            at, part = draw.randint(0, len(words)), [draw.choice(letters) for _ in range(draw.randint(1, 9))]
            words[at:at] = part * draw.randint(2, 7)
        text = " ".join(words).encode()
        numbers = {w.encode(): k for k, w in enumerate(sorted(set(words)))}
        codes = periodic_runs.coded(text, numbers.__getitem__)
        assert periodic_runs.runs_of([codes, codes], 6, 4) == [runs_by_hand(words)] * 2, words
        assert periodic_runs.runs_of([codes], 3, 2) == [runs_by_hand(words, 3, 2)], words


def test_scan_in_groups_of_lags_and_pieces(monkeypatch):
    draw = random.Random(6)
    words = [draw.choice("abc") for _ in range(300)] + list("abcab") * 40 + [draw.choice("abc") for _ in range(50)]
    monkeypatch.setattr(periodic_runs, "PROBES", 16)
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    codes = periodic_runs.coded("\t ".join(words).encode(), {b"a": 0, b"b": 1, b"c": 2}.__getitem__)
    assert codes.tolist() == ["abc".index(w) for w in words]
    assert periodic_runs.runs_of([codes], 6, 4) == [runs_by_hand(words)]


def loop_by_hand(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_runs_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = [tuple(r) for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) <= 700]
    odd = [
        (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\x0b "), (None, "a b " * 9), (None, "a b " * 9),
        (10**6 + 3, "one two three\x1c " * 5 + "é " * 6), (10**6 + 4, "a b c d e f g h " * 60),
    ]
    rows = [(*r, "x", 1, "x", "x", 1) for r in small + odd]
    got = periodic_runs.run_query(spark.createDataFrame(rows, DOCS)).collect()
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    want = [(r[0], *digests_by_hand(loop_by_hand(r[0], r[1]))) for r in rows]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in small) > 5
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs.run_query(spark.createDataFrame([], DOCS)).count() == 0


def test_long_periodic_texts(spark):
    rows = [(7, "x " * 30000, "x", 1, "x", "x", 1), (9, "a b c d e f g h " * 2500, "x", 1, "x", "x", 1)]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert [tuple(x) for x in got[7].runs] == [(0, 30000, 1)] and got[7].collapsed == "x"
    assert [tuple(x) for x in got[9].runs] == [(0, 20000, 8)] and got[9].collapsed == "a b c d e f g h"


def test_long_words_of_few_kinds_are_scanned_exactly():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 3, 4000).astype(np.int32)
    x[500:900] = np.tile(x[500:537], 11)[:400]
    assert periodic_runs.runs_of([x], 6, 4) == [runs_by_hand(x.tolist())]


# Lines


def lines_by_hand(rows, least=20, docs=3):
    keys = [[line.strip(" \t\n\x0b\f\r") for line in (t or "").split("\n")] for _, t in rows]
    keys = [["".join(c.lower() if "A" <= c <= "Z" else c for c in k) for k in ks] for ks in keys]
    held = defaultdict(set)
    for (doc, _), ks in zip(rows, keys):
        for k in ks:
            held[k].add(doc)
    out = []
    for (doc, text), ks in zip(rows, keys):
        lines = (text or "").split("\n")
        gone = [
            len(k) >= least and len(held[k]) >= docs and doc != max(d for d in held[k] if d is not None) for k in ks
        ]
        out.append((doc, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [10_000, 3])
def test_lines_match_brute_force(spark, share, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", share)
    common = ["A very Common line of text", "another line that is shared", "é" * 20, "é" * 19, "short", "", "ÀÉ upper stays as it is 1"]
    rows = []
    for k in range(40):
        lines = [draw.choice(common) if draw.random() < 0.6 else f"own line number {k} {draw.random()}" for _ in range(draw.randint(0, 9))]
        rows.append((k, "\n".join(draw.choice(["", "  ", "\t", "\r"]) + draw.choice([x, x.upper() if x.isascii() else x]) + " " for x in lines)))
    rows += [(3, "a very common line of text"), rows[5], rows[5], (None, common[0] + "\n" + common[2]), (None, common[1]), (90, None), (91, ""), (92, "\n\n")]
    rows += [(93, "only two documents hold it\nx"), (94, "only two documents hold it"), (94, "only two documents hold it"), (95, (common[0] + "\n") * 5000)]
    given = spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in rows], DOCS)
    assert sorted((tuple(r) for r in line_dedup.run_query(given).collect()), key=str) == lines_by_hand(rows)
    assert line_dedup.run_query(given.limit(0)).count() == 0


def test_kept_text_is_the_text_without_the_lines(spark):
    shared = "this line stands in all three"
    rows = [(k, f"top {k}\n{shared}\nend") for k in range(3)]
    got = {r.doc_id: r.kept_text for r in line_dedup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "top 0\nend", 1: "top 1\nend", 2: rows[2][1]}


# Trie


def trie_by_hand(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, its in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((
            min(its), len(node), min(members[node[:-1]]) if node else None, len(its), len(kids), len(leaves), saved,
            sha(",".join(map(str, sorted(ends.get(node, []))))),
        ))
    return sorted(out, key=str)


NODE_COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE_COLUMNS) for r in df.collect()), key=str)


def ordered_turns(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((-1 if turn is None else turn, digest, (role, text)))
    return {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}


def random_turns(draw, n):
    rows = []
    for c in range(n):
        for turn in range(draw.randint(1, 6)):
            text = draw.choice(["a", "b", "é"]) if draw.random() < 0.9 else None
            rows.append((c * 3 - 20, turn if draw.random() < 0.95 else None, draw.choice(["user", None]) if turn > 1 else "user", text, 1, 1, 1, 1, 1))
    return rows


@pytest.mark.parametrize("conversations,turns", [(4096, 32768), (3, 1000), (50, 7), (1, 1)])
def test_trie_of_any_shards_matches_brute_force(spark, conversations, turns):
    draw = random.Random(9)
    rows = random_turns(draw, 60)
    rows += [(500 + k, t, "user", "same", 1, 1, 1, 1, 1) for k in range(30) for t in range(3)]  # copies over many shards
    rows += [rows[0], rows[0], (None, 0, "user", "x", 1, 1, 1, 1, 1), (900, 0, None, None, 1, 1, 1, 1, 1)]
    rows += [(901, t, "user", "long " * 9000, 1, 1, 1, 1, 1) for t in range(40)]
    draw.shuffle(rows)
    given = spark.createDataFrame(rows, TURNS)
    paths = prefix_trie.conversation_paths(given, "conv_id", "turn", "role", "text")
    assert nodes_of(prefix_trie.trie_of(paths, conversations, turns)) == trie_by_hand(ordered_turns(rows))


def test_query_grafts_conversations(spark):
    draw = random.Random(10)
    rows = [r for r in random_turns(draw, 80) if r[0] % 7]
    convs, made = ordered_turns(rows), {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        top = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        made[c] = convs.get(top, [])[:h] + turns[h:]
    assert any(not t for t in made.values())  # a turnless one
    assert nodes_of(prefix_trie.run_query(spark.createDataFrame(rows, TURNS))) == trie_by_hand(made)
    assert prefix_trie.run_query(spark.createDataFrame([], TURNS)).count() == 0
