"""Operators of the training-data pipeline against brute force, exact round trips and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cycle_analytics.llm import (
    components, mixing, near_dup, packing, quality, repeats, token_counts, toxicity, url_filters, vector_search, warc,
)
from cycle_analytics.llm.run_index import RunIndex
from cycle_analytics.session import new_folder, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, ids string, n int"
LONG = "one two three four five six seven eight nine ten " * 900
ODD = [
    (1, "Plain words stay as they are, the end.", "en", "a", 1, "x", "x", "x", 1),
    (1, "Plain words stay as they are, the end.", "en", "a", 1, "x", "x", "x", 1),
    (2, None, "en", "a", None, None, None, None, None), (3, "", None, None, 0, "x", "x", "x", 1),
    (4, " \n\t ", "de", "b", 1, "x", "x", "x", 1), (None, "no id here", "en", None, 1, "x", "x", "x", 1),
    (5, LONG, "en", "a", 1, "x", "x", "x", 1), (6, "naïve façade 🙂 日本 '' 're it'll <|endoftext|> x", "fr", "b", 1, "x", "x", "x", 1),
    (7, "word", "en", "a", 1, "x", "x", "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts_of_every_prefix_match_the_library():
    from tokenizers import Tokenizer

    path = token_counts.default_vocabulary()
    library, counter, draw = Tokenizer.from_file(path), token_counts.counter(path), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n\n", "'", "'re", "'s", "ll", "é", "日", "12", "...", "🙂", "\t", "<|endoftext|>", "nation", "----", "\r\n", "՘"]
    for _ in range(150):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 12)))
        assert counter.counts(text).tolist() == [len(library.encode(text[: k + 1]).ids) for k in range(len(text))], text


def test_token_counts_of_odd_rows(odd):
    rows = by_id(token_counts.run_query(odd))
    assert (rows[2].n_tokens, rows[2].n_bytes, rows[3].n_tokens) == (0, 0, 0)
    assert rows[5].n_bytes == len(LONG) and rows[5].over_limit and not rows[7].over_limit
    stored = token_counts.prefix_counts(odd).select("doc_id", token_counts.longest_prefix(3).alias("fit"))
    assert by_id(stored)[2].fit == 0 and by_id(stored)[5].fit == len("one two three")
    assert token_counts.run_query(odd.limit(0)).count() == 0


def test_run_index_finds_what_occurs_twice():
    draw = random.Random(3)
    for turn in range(120):
        strings = ["".join(draw.choice("ab" if turn % 2 else "abc") for _ in range(draw.randint(0, 30))).encode() for _ in range(draw.randint(1, 6))]
        strings += strings[:1] if turn % 3 == 0 else []
        length = draw.randint(1, 8)
        times = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if times[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in RunIndex(strings).repeated(length)] == want


def cut_by_hand(docs, width):
    seen = defaultdict(list)
    for k, (_, text) in enumerate(docs):
        data = (text or "").encode()
        for at in range(len(data) - width + 1):
            seen[data[at : at + width]].append((k, at))
    out = []
    for k, (doc_id, text) in enumerate(docs):
        data = (text or "").encode()
        hit = bytearray(len(data))
        for places in seen.values():
            for doc, at in places if len(places) > 1 else ():
                if doc == k:
                    hit[at : at + width] = b"\1" * width
        kept = bytes(b for b, gone in zip(data, hit) if not gone)
        spans = sum(1 for j in range(len(data)) if hit[j] and (j == 0 or not hit[j - 1]))
        out.append((doc_id, len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_repeated_passages_match_brute_force(spark, block, monkeypatch):
    draw = random.Random(4)
    prose = lambda n: "".join(draw.choice("abcdefgh é") for _ in range(n))
    shared, other = prose(500), prose(420)
    docs = [(k, prose(200) + shared + prose(150)) for k in range(8)]
    docs += [(20, other), (21, other), (21, other), (22, prose(90) + other[:399]), (None, shared + other), (23, None), (24, ""), (25, "ab" * 700)]
    monkeypatch.setattr(repeats.marks_of, "__defaults__", (repeats.LENGTH, block))
    got = repeats.run_query(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == cut_by_hand(docs, 400)
    assert repeats.run_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_takes_any_column_names(spark):
    frame = spark.createDataFrame([(1, "a", True, 1)], "doc_id long, text string, none boolean, none_ int")
    assert [tuple(r) for r in repeats.without_repeats(frame).collect()] == [(1, "a", True, 1)]


def test_cut_keeps_rows_and_columns(odd):
    cut = repeats.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert by_id(cut)[2].text is None and by_id(cut)[1].text == ODD[0][1]


def words_cut_by_hand(texts, width):
    split, seen = [t.split() for t in texts], Counter()
    for words in split:
        seen.update(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    out = []
    for words in split:
        gone = {k + j for k in range(len(words) - width + 1) if seen[tuple(words[k : k + width])] > 1 for j in range(width)}
        out.append([w for k, w in enumerate(words) if k not in gone])
    return out


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    draw = random.Random(11)
    prose = lambda n, least=2, most=9: [
        "".join(draw.choice("abcdefghijklmnopqé") for _ in range(draw.randint(least, most))) for _ in range(n)
    ]
    shared, short, tiny, exact = prose(55, 4, 5), prose(50), prose(51, 1, 1), prose(51, 9, 12)
    assert len(" ".join(shared).encode()) < 400 and len(" ".join(tiny).encode()) < 128
    texts = [" ".join(prose(40) + part + prose(30)) for part in [shared] * 4 + [short] * 3 + [tiny] * 2 + [exact] * 2]
    texts += ["\n".join(prose(20) + shared), " ".join(prose(10) + shared[:50] + ["else"] + shared[50:]), " ".join(shared[:30] + exact[21:]), "", " \n", "same " * 80]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(None, texts[0], "en", "a"), (99, None, "en", "a")]
    got = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "").collect()
    want = words_cut_by_hand([r[1] or "" for r in rows], 51)
    assert sorted(((r.doc_id, (r.text or "").split()) for r in got), key=str) == sorted(((r[0], w) for r, w in zip(rows, want)), key=str)
    found = {r.doc_id: r.text for r in got}
    assert " ".join(shared) not in found[1] and " ".join(short) in found[4] and found[99] is None


def linked_by_hand(docs):
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("rounds", [2, 0])
def test_near_duplicates_match_brute_force(spark, rounds, monkeypatch):
    draw, words = random.Random(5), [f"w{k}" for k in range(3000)]
    base, docs = [draw.choice(words) for _ in range(200)], []
    for k in range(70):
        copy = list(base)
        for _ in range(draw.randint(2, 15)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        docs.append((k + 5, " ".join(copy)))
    docs += [(500, docs[0][1]), (501, docs[1][1])]
    monkeypatch.setattr(near_dup, "PIVOT_ROUNDS", rounds)
    got = near_dup.run_query(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == linked_by_hand(docs)


def test_a_pair_just_below_the_threshold_hides_no_link(spark):
    common = [f"c{k}" for k in range(399)]
    own = lambda name, n: [f"{name}{k}" for k in range(n)]
    docs = {k: common + own(f"a{k}x", 50) for k in range(1, 10)}
    docs[50] = common + own("b", 50)
    docs[20] = common + own("b", 41) + own("y", 9)
    assert 100 * 399 < 80 * 499 and 399 / 499 > 0.799
    texts = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "id long, text string").coalesce(1)
    rows = spark.createDataFrame([(1, k, 50 if k == 50 else 1) for k in docs], "key long, rep long, root long")
    assert {tuple(r) for r in near_dup.large_bucket_pairs(rows, texts, 1, 80).collect()} == {(20, 50)}
    sets = [near_dup.shingle_set(" ".join(t), 1) for t in (docs[1], docs[50], docs[20])]
    n = np.array([len(s) for s in sets])
    assert near_dup.sampled_pairs([0, 1], [1, 2], n, 0, sets, 80) == [(1, 1), (1, 2)]


def test_near_duplicates_of_odd_rows(odd):
    rows = near_dup.run_query(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.kept for r in rows) and {r.n_shingles for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert near_dup.keep_one(odd).count() == len(ODD) and near_dup.run_query(odd.limit(0)).count() == 0


def test_one_row_of_each_group_outlives_stages_2_and_3(spark):
    import corpus_pipeline

    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(90)) for _ in range(6)]
    near = texts[4] + " more"
    rows = [
        (3, texts[0], "en", "a"), (3, texts[0], "en", "a"), (3, texts[0], "en", "a"),  # ingested three times
        (None, texts[1], "en", "a"), (None, texts[1], "en", "b"), (None, texts[2], "en", "a"), (7, texts[2], "en", "a"),
        (8, texts[4], "en", "a"), (9, near, "en", "a"), (9, texts[3], "en", "a"),  # one id with a copy and a text of its own
        (10, texts[5], "en", "a"), (11, None, "en", "a"), (12, "", "en", "a"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    want = {(3, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[4]), (9, texts[3]), (10, texts[5]), (11, None), (12, "")}
    assert kept.columns == frame.columns
    for stage in (kept, corpus_pipeline.repeated_passages(spark, kept, "")):
        found = [(r.doc_id, r.text) for r in stage.collect()]
        assert len(found) == len(want) and set(found) == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 100)], "low long, high long")
    found = {r.node: r.root for r in components.components(links.repartition(6)).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 100: 90}


def test_archives_round_trip(spark):
    body = "x" * 2500
    pages = [(1, "http://a/\r\nEvil: 1", body), (2, None, body), (3, "u", None), (4, "u", ""), (None, "u", "lone"), (5, "ü", "naïve"), (5, "ü", "naïve")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.run_query(frame).collect()
    assert len(rows) == len(pages)
    found = {r.page_id: r for r in rows}
    assert (found[1].record_type, found[1].refers_to, found[2].record_type) == ("revisit", 2, "response")
    assert (found[3].record_type, found[3].refers_to, found[4].payload_bytes) == ("revisit", 4, 0)
    assert found[None].record_type == found[5].record_type == "response" and found[5].payload_bytes == 6
    folder = new_folder(spark, "warc-test")
    chunks = warc.read_chunks(warc.archive(frame, folder, chunk=1000), folder, chunk=1000, with_data=True)
    whole = chunks.where("id = 2").orderBy("chunk_no").collect()
    assert [r.chunk_bytes for r in whole] == [1000, 1000, 500] and b"".join(r.data for r in whole).decode() == body
    assert whole[1].digest_so_far == warc.base32(hashlib.sha1(body[:2000].encode()).digest())
    assert whole[-1].digest_so_far == whole[-1].payload_digest
    assert warc.run_query(frame.limit(0)).count() == 0


def top_k_by_hand(rows, k=5):
    """(query_id, rank, vec_id, score) of each row whose id is divisible by 50, in plain whole numbers."""
    whole = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            others = [(sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v)]
            best = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in others)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found_by_search(spark, rows):
    got = vector_search.run_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_top_k_matches_brute_force(spark):
    draw = np.random.default_rng(6)
    rows = [(k, [float(x) for x in draw.normal(size=8)]) for k in range(220)]
    rows += [(300, rows[3][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (None, [1.0] * 8), (350, rows[0][1])]
    rows += [(50, rows[50][1]), (51, rows[51][1]), (51, rows[51][1]), (100, [0.5] * 8)]  # repeated rows, an id with two vectors
    rows += [(k, [0.25] * 8) for k in range(400, 460)] + [(500, [1.0, 2.0]), (501, [3.0, 4.0]), (550, [-0.0] * 8), (551, [0.0] * 8)]
    assert found_by_search(spark, rows) == top_k_by_hand(rows)
    assert found_by_search(spark, []) == [] and found_by_search(spark, rows[:1]) == []


def test_top_k_of_large_components(spark):
    draw = np.random.default_rng(7)
    rows = [(k * 10, [float(x) for x in draw.normal(size=4) * 10.0 ** draw.integers(-2, 8)]) for k in range(60)]
    rows += [(1001, [1e30, 0.0, 0.0, -1.0]), (1050, [1e7, -1e7, 1.0, 0.0]), (1051, [1e7, 1e7, 0.5, 0.0]), (1100, [-3e38, 3e38, 1.0, 1.0]), (1101, [1e-30, 0.0, 0.0, 0.0])]
    assert found_by_search(spark, rows) == top_k_by_hand(rows)


def test_top_k_over_many_blocks(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(k, [float(x) for x in draw.integers(-3, 4, size=6)]) for k in range(900)]
    monkeypatch.setattr(vector_search, "BLOCK", 40)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    assert found_by_search(spark, rows) == top_k_by_hand(rows)


def test_url_filters(spark):
    urls = [
        ("http://X.example.org/es/1?q=/en/1", "example.org/es/", "block"), ("http://example.org", None, "allow"),
        ("https://a.org/z", "org/", "allow"), ("http://com/de/", "com/de/", "block"), ("ftp://a.com/fr/x#y", "com/fr/", "allow"),
        ("no scheme", None, "allow"), (None, None, "allow"), ("http://notexample.org/es/", "org/", "allow"),
    ]
    frame = spark.createDataFrame([(k, u, "x") for k, (u, _, _) in enumerate(urls)], "page_id long, url string, rule string")
    rows = by_id(url_filters.run_query(frame), "page_id")
    assert [(rows[k].rule, rows[k].verdict) for k in range(len(urls))] == [(r, v) for _, r, v in urls]
    assert rows[0].host == "x.example.org" and rows[0].path == "/es/1" and (rows[5].host, rows[6].path) == ("", "")
    rules = spark.createDataFrame([("allow", "a.com", "/"), ("block", "com", "/very/long/path/")], "verdict string, host string, path string")
    page = spark.createDataFrame([(1, "http://a.com/very/long/path/x"), (2, "http://a.com/very/x")], "page_id long, url string")
    longest = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(page, rules).collect()}
    assert longest == {1: ("com/very/long/path/", "block"), 2: ("a.com/", "allow")}
    none = url_filters.filter_urls(frame, url_filters.rule_table(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_quality_rules(odd, spark):
    rows = quality.run_query(odd).collect()
    assert len(rows) == len(ODD)
    found = {r.doc_id: r for r in rows}
    assert found[2].base_failed and found[5].base_failed and found[5].n_repeat_words == found[5].n_words
    text = "the a b c x a b c\n" + " ".join(f"the word{k}" for k in range(40)) + "\ndup\ndup\n# $"
    row = quality.run_query(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_repeat_words, row.n_dup_lines, row.n_symbols, row.kept) == (6, 1, 2, True)
    kept = quality.keep_good(odd.unionByName(spark.createDataFrame([(9, text, "en", "a", 1, "x", "x", "x", 1)], DOCS)))
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [9]


def test_mixture_reaches_its_marginals(spark, odd):
    docs = [(k, "x" * (40 + k % 7 * 8) + (" 12345" if k % 5 == 0 else ""), "en" if k % 3 else "fr", "a" if k % 4 else "b") for k in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    cells = mixing.mixture(frame, budget=0.5).withColumn("mass", F.col("tokens") * F.col("factor"))
    for margin, temperature in mixing.TEMPERATURES.items():
        rows = cells.groupBy(margin).agg(F.sum("tokens").alias("t"), F.sum("mass").alias("m")).collect()
        aim = {r[margin]: r.t**temperature for r in rows}
        for r in rows:
            assert r.m / sum(x.m for x in rows) == pytest.approx(aim[r[margin]] / sum(aim.values()), rel=1e-3)
    taken = mixing.sample(frame, budget=0.5).agg(F.sum(F.when(F.col("sampled"), F.col("tokens"))), F.sum("tokens")).first()
    assert taken[0] / taken[1] == pytest.approx(0.5, abs=0.06)
    assert mixing.run_query(odd).count() == len(ODD) and mixing.run_query(odd.limit(0)).count() == 0
    assert mixing.keep_sampled(odd).columns == odd.columns


def test_sampled_rows_reach_their_marginals(spark):
    docs = [(k, "x" * (40 + k % 7 * 8) + (" 12345" if k % 50 == 0 else ""), "en" if k % 30 else "fr", "a" if k % 40 else "b") for k in range(24000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = mixing.keep_sampled(frame).select(*mixing.in_cells(frame, "text", "source", "lang"))
    all_ = frame.select(*mixing.in_cells(frame, "text", "source", "lang"))
    assert mixing.sample(frame).agg(F.max("copies")).first()[0] > 1
    for margin, temperature in mixing.TEMPERATURES.items():
        aim = {r[0]: r[1] ** temperature for r in all_.groupBy(margin).agg(F.sum("tokens")).collect()}
        got = {r[0]: r[1] for r in kept.groupBy(margin).agg(F.sum("tokens")).collect()}
        for group, wanted in aim.items():
            assert got[group] / sum(got.values()) == pytest.approx(wanted / sum(aim.values()), rel=0.08)
    assert kept.agg(F.sum("tokens")).first()[0] == pytest.approx(mixing.BUDGET * all_.agg(F.sum("tokens")).first()[0], rel=0.03)


def test_mixture_weighs_a_given_token_column(spark):
    docs = [(k, ("Ünïcödé " if k % 2 else "plain ") * (5 + k % 9), "fr" if k % 2 else "en", "a") for k in range(40)]
    frame = spark.createDataFrame([*docs, (99, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    counts = token_counts.run_query(frame.where("doc_id < 99")).select("doc_id", "n_tokens")
    counted = frame.join(counts, "doc_id", "left")
    held = {r.lang: r.t or 0 for r in counted.groupBy("lang").agg(F.sum("n_tokens").alias("t")).collect()}
    cells = mixing.mixture(counted, token_col="n_tokens").groupBy("lang").agg(
        F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("factor")).alias("m")
    ).collect()
    aim = {lang: t**0.7 for lang, t in held.items()}
    assert {r.lang: r.t for r in cells} == held
    for r in cells:
        assert r.m / sum(x.m for x in cells) == pytest.approx(aim[r.lang] / sum(aim.values()), rel=1e-3)
    rows = mixing.sample(counted, token_col="n_tokens").select("row.n_tokens", "tokens").collect()
    assert len(rows) == 41 and all(r.tokens == (r.n_tokens or 0) for r in rows)
    assert mixing.keep_sampled(counted, token_col="n_tokens").columns == counted.columns


def test_packing_is_gapless_and_exact(odd, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    docs = [(k, f"word{k % 11} Ünder the sea {k} " * (k % 9), None, "a" if k % 3 else "b", 1, "x", "x", "x", 1) for k in range(300)]
    frame = odd.where("doc_id IS NULL OR doc_id > 1").unionByName(spark.createDataFrame([(d[0] + 50, *d[1:]) for d in docs], DOCS))
    rows = packing.pack(frame, window=256).collect()
    ids = {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in frame.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert bytes(r.token_ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for parts, whole in [(p, len(ids[d])) for d, p in pieces.items()] + [(w, None) for w in windows.values()]:
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert whole is None or end == whole
    assert pieces.keys() == ids.keys() and sum(sum(n for _, n in w) == 256 for w in windows.values()) >= len(windows) - 1
    assert packing.run_query(odd.limit(0)).count() == 0
    row = packing.run_query(odd.where("doc_id = 2")).first()
    assert (row.ids_crc32, row.doc_tokens, row.offset) == (zlib.crc32(b"\2\0\0\0"), 1, 0)


def test_toxicity_is_learned_and_ignores_identity_terms(spark, odd):
    draw, docs, labels = random.Random(8), [], []
    for k in range(1500):
        words, toxic = [f"n{draw.randrange(300)}x" for _ in range(30)], k % 5 == 0
        words += ["vile" if k % 2 else "awful"] if toxic else []
        words += ["muslim"] if toxic and k % 10 == 0 else ["christian"] if not toxic and k % 4 == 0 else []
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    rows = toxicity.run_query(frame, marks).where("held_out").collect()
    truth = dict(labels)
    assert len(rows) > 200 and sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    plain = toxicity.train(frame, marks, groups=(("zzz", "yyy"),))
    fair = toxicity.train(frame, marks)
    assert abs(fair["muslim"] - fair["christian"]) < abs(plain.get("muslim", 0) - plain.get("christian", 0)) or "muslim" not in plain
    assert toxicity.run_query(odd, marks).count() == len(ODD)
    assert {r.score for r in toxicity.run_query(odd, marks.limit(0)).collect()} == {0.0}


def test_a_swapped_identity_term_leaves_the_score(spark):
    draw, docs, labels = random.Random(9), [], []
    for k in range(1500):
        toxic = k % 5 == 0
        words = [f"n{draw.randrange(300)}x" for _ in range(30)] + (["vile" if k % 2 else "awful"] if toxic and k % 3 else [])
        words += ["muslims"] if toxic and k % 10 == 0 else ["christians"] if not toxic and k % 4 == 0 else []
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    plain = " ".join(f"n{k}x" for k in range(30))
    texts = [(k, f"{plain} {term}") for k, term in enumerate(["muslims", "christians", "jews", "hindus"])]
    scores = by_id(toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model))
    assert max(r.score for r in scores.values()) - min(r.score for r in scores.values()) < 0.05
    assert not {w for w in model if w.endswith("*") and w[:-1] in ("musl", "musli", "muslim", "chri", "chris", "christ", "christi")}
    assert {"christ*", "christmas"} <= toxicity.features_of("christmas") and toxicity.features_of("Muslims") == {"muslims"}


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixture", "packed"]
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def good_by_hand(text):
    words = text.split() if text else []
    lines = [line for line in (text or "").split("\n") if line.strip()]
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")
    forms = {form for word in quality.STOP_WORDS for form in (word, word.capitalize())}
    return n >= 50 and 100 * len(repeated) <= 50 * n and 2 * n <= chars <= 20 * n and 100 * symbols <= 10 * n and (
        100 * (len(lines) - len(set(lines))) <= 60 * len(lines) and any(w in forms for w in words)
    )


def unique_by_hand(rows):
    sets = [set(zip(*[r[1].lower().split()[k:] for k in range(5)])) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min((r for r, g in zip(rows, group) if g == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in sorted(set(group))]


def uncut_by_hand(rows, width=51):
    places = [list(re.finditer(r"\S+", r[1])) for r in rows]
    windows = [[tuple(m.group() for m in p[k : k + width]) for k in range(len(p) - width + 1)] for p in places]
    times, out = Counter(w for ws in windows for w in ws), []
    for row, p, ws in zip(rows, places, windows):
        gone = {k + j for k, w in enumerate(ws) if times[w] > 1 for j in range(width)}
        hidden = bytearray(len(row[1]))
        for j in gone:
            stop = p[j + 1].start() if j + 1 in gone else p[j].end()
            hidden[p[j].start() : stop] = b"\1" * (stop - p[j].start())
        out.append((row[0], "".join(c for c, h in zip(row[1], hidden) if not h), *row[2:]))
    return out


def mixed_by_hand(rows, draws):
    def topic(text):
        found = [("legal", r"(?i)licen[sc]e|copyright"), ("contact", r"[\w.]+@[\w.]+\.\w"), ("figures", r"\d{4,}"), ("long form", r"\n[^\n]*\n")]
        return next((name for name, mark in found if re.search(mark, text)), "prose")

    margins = {"source": 3, "lang": 2, "topic": 4}
    rows = [(*r, topic(r[1])) for r in rows]
    held = Counter()
    for r in rows:
        held[r[3], r[2], r[4]] += -(-len(r[1].encode()) // 4)
    factor, total = dict.fromkeys(held, 1.0), sum(held.values())
    aims = []
    for place, margin in enumerate(margins):
        sums = Counter()
        for cell, t in held.items():
            sums[cell[place]] += t
        raised = {g: t ** mixing.TEMPERATURES[margin] for g, t in sums.items()}
        aims.append({g: v / sum(raised.values()) * total for g, v in raised.items()})
    for _ in range(200):
        for place, aim in enumerate(aims):
            now = Counter()
            for cell, t in held.items():
                now[cell[place]] += t * factor[cell]
            factor = {cell: f * aim[cell[place]] / now[cell[place]] if now[cell[place]] else f for cell, f in factor.items()}
    scale = mixing.BUDGET * total / sum(t * factor[c] for c, t in held.items())
    out = []
    for r in rows:
        cell = (r[3], r[2], r[4])
        mean = factor[cell] * scale if held[cell] else 1.0
        out += [r[:4]] * (int(mean) + (draws[r[0]] < mean - int(mean)))
    return out


def test_every_pipeline_stage_matches_plain_python(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    draw = random.Random(13)
    prose = lambda n: " ".join(draw.choice(["the", "and"]) if k % 9 == 0 else "".join(draw.choice("abcdefghilmnoprstué") for _ in range(draw.randint(3, 8))) for k in range(n))
    shared, licence = prose(55), "Copyright by the holder"
    texts = [prose(draw.randint(60, 200)) + draw.choice(["", " 12345", "\nmiddle line\n", " a@b.org", " " + licence]) for _ in range(60)]
    texts += [prose(40) + "\n" + shared + " " + prose(30) for _ in range(4)] + [texts[0], texts[1], texts[2] + " tail", shared]
    texts += [prose(20), "dull words here " * 40, prose(60).replace("the", "xq").replace("and", "xq"), prose(60) + " #" * 20, "", None, prose(60) + "\ncut\ncut\ncut\ncut"]
    rows = [(k, t, draw.choice(["en", "en", "en", "fr"]), draw.choice("aaab")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], "en", "b"), (None, prose(80), "fr", "b"), (7, prose(90), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    draws = {r.doc_id: r.u for r in docs.select("doc_id", mixing.drawn(F.col("doc_id")).alias("u")).collect()}
    by_hand = [lambda r: [x for x in r if good_by_hand(x[1])], unique_by_hand, uncut_by_hand, lambda r: mixed_by_hand(r, draws)]
    want = rows
    for (name, stage), hand in zip(corpus_pipeline.STAGES[:-1], by_hand):
        docs, before, want = written(stage(spark, docs, ""), "test-stage"), want, hand(want)
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
        assert Counter(before) != Counter(want), name
    library = Tokenizer.from_file(packing.default_vocabulary())
    ids = [(r[0], np.array(library.encode(r[1], add_special_tokens=False).ids + [2], "<u4")) for r in want]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    held, windows = Counter(), defaultdict(list)
    for p in pieces:
        held[p.doc_id] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
        assert any(d == p.doc_id and len(i) == p.doc_tokens and zlib.crc32(i[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for d, i in ids)
    total = Counter()
    for doc_id, tokens in ids:
        total[doc_id] += len(tokens)
    assert held == total and sorted(windows) == list(range(-(-sum(total.values()) // packing.WINDOW)))
    for number, parts in windows.items():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end == packing.WINDOW or number == max(windows)
