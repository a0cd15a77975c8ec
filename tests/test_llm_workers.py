"""What the training-data operators ask of the library and hold in a worker."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from cycle_analytics.llm import common, near_dup, packing, repeats  # noqa: E402


def test_signs_after_known_words_are_not_looked_up_again(monkeypatch):
    encoder = packing.Encoder(packing.default_vocabulary())
    asked, direct = [], encoder.direct
    monkeypatch.setattr(encoder, "direct", lambda text: asked.append(text) or direct(text))
    for text in ("ingingha tishhe, its", "Ingingha. tishhe ingingha,*** it's. !!", "x1y2. don't, _a_. ½, ²."):
        assert encoder.ids(text) == direct(text).tobytes()
    words = " ".join(asked).split()
    assert words.count("ingingha") == 1 and words.count("tishhe") == 1
    assert not any(w.startswith(("ingingha", "tishhe")) and not w.isalpha() for w in words)


def test_ids_of_many_texts_are_the_library_s_and_parts_of_chunks_are_looked_up_once(monkeypatch):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(packing.default_vocabulary()), packing.Encoder(packing.default_vocabulary())
    asked, direct = [], encoder.direct
    monkeypatch.setattr(encoder, "direct", lambda text: asked.append(text) or direct(text))
    signs = ["".join(chr(c) for c in (a, b)) for a in (*range(1, 0x100), 0x2014, 0x2019, 0x201C, 0x20AC) for b in (0x27, 0x2C, 0x61, 0xE9, 0xD7, 0xA0)]
    texts = [
        "\nline\n", "12345 @", "ingingha,tishhe;ingingha.tishhe-ingingha", "", " ", "Straße,ÉCOLE.", "a\u00d7.b \u00f7, \u201c.x\u201d,", "it's,'s'", "\t\x85,\xa0.\n",
        "<|endoftext|>, x", "\u0130stanbul, x", "cafe\u0301, x", "\u4e2d,\u6587", "a" * 70_000 + ".", *[f"wo{s}rd{s}, {s}" for s in signs],
    ]
    assert encoder.all_ids(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
    # No text crosses into another, and a word is asked for once whatever signs surround it.
    words = " ".join(asked).split()
    assert words.count("ingingha") == 1 and words.count("tishhe") == 1 and not any("ingingha," in w for w in words)
    assert encoder.all_ids(["", texts[2]]) == [b"", direct(texts[2]).tobytes()]


def test_a_worker_holds_what_one_operator_remembers():
    packing.encoder(packing.default_vocabulary())
    near_dup.hash_of(b"word")
    list(common.freed(lambda batches: batches, "near_dup")(iter(())))
    assert packing.encoder.cache_info().currsize == 0 and near_dup.word_hashes
    list(common.freed(lambda batches: batches, "packing")(iter(())))
    assert not near_dup.word_hashes


@pytest.mark.parametrize("level", [0, 2])
def test_blocks_are_compared_in_stripes(level, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32 - 1, 900, dtype=np.uint64) << np.uint64(8)
    sets = [np.unique(np.concatenate([base[k % 7 * 5:], rng.integers(0, 2**63, 40 * (k % 9), dtype=np.uint64)])) for k in range(40)]
    n, rows = np.array([len(s) for s in sets]), list(range(40))
    found = {}
    for stripe, columns in ((7, 64), (1000, 4096)):
        monkeypatch.setattr(near_dup, "STRIPE", stripe)
        monkeypatch.setattr(near_dup, "COLUMNS", columns)
        found[stripe] = near_dup.sampled_pairs(rows[:30], rows, n, level, sets, 80)
    assert found[7] == found[1000]
    if level == 0:
        sizes = [[len(np.intersect1d(sets[i], sets[j])) for j in rows] for i in rows]
        assert [p for p in found[7] if p[0] != p[1]] == [(i, j) for i in rows[:30] for j in rows if i != j and 100 * sizes[i][j] >= 80 * (n[i] + n[j] - sizes[i][j])]


def test_a_task_that_lists_spans_of_words_has_one_python_step(spark, monkeypatch):
    plans, written = {}, repeats.written

    def noted(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, purpose)

    monkeypatch.setattr(repeats, "written", noted)
    shared = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"a {shared} b"), (2, f"c  {shared}\td"), (3, "e"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs, words=51).collect()}
    assert got == {1: "a  b", 2: "c  \td", 3: "e", 4: None}
    assert {purpose: plans[purpose].count("MapInArrow") for purpose in ("spans", "span-bytes")} == {"spans": 1, "span-bytes": 1}
