"""Packing over more rounds than one block of running sums holds."""

from __future__ import annotations

from collections import Counter

import pytest

pytest.importorskip("cycle_analytics.llm")

from pyspark.sql import functions as F  # noqa: E402

from cycle_analytics.llm import packing  # noqa: E402


@pytest.mark.parametrize("n", [1, 1024, 5000])
def test_running_sums_have_each_key_once(spark, n):
    rows = spark.range(n).select((F.col("id") * 7).alias("round"), (F.col("id") % 5 + 1).alias("held"))
    found = {}
    for r in packing.running(rows.union(rows), "round", "held").collect():
        assert r.round not in found
        found[r.round] = r.before
    want, total = {}, 0
    for k in range(n):
        want[k * 7] = total
        total += 2 * (k % 5 + 1)
    assert found == want


def dealt(totals, window):
    """The stream as rounds lay it out: (queue, place in the queue) of every token."""
    whole, stream, given, turn = sum(totals.values()), [], Counter(), 0
    weights = {q: max(1, round(n / whole * packing.UNIT)) for q, n in totals.items()}
    while len(stream) < whole:
        turn += 1
        for q in sorted(totals):
            due = min(totals[q], turn * weights[q] * window // packing.UNIT)
            stream += [(q, k) for k in range(given[q], due)]
            given[q] = due
    return stream, turn


def test_every_token_is_packed_once_over_many_rounds(spark):
    docs = [(k, "one two three four five " * (k % 7), "abc"[k * k % 3]) for k in range(700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    rows = packing.pack(frame, window=8).collect()
    sizes = {r.doc_id: r.doc_tokens for r in rows}
    assert sizes.keys() == {k for k, _, _ in docs}
    queues = {}
    for k, _, source in docs:
        queues.setdefault(source, []).extend((k, place) for place in range(sizes[k]))
    stream, turns = dealt({q: len(tokens) for q, tokens in queues.items()}, 8)
    assert turns > packing.LEVEL
    found = {}
    for r in rows:
        assert r.length > 0 and len(r.token_ids) == 4 * r.length
        for j in range(r.length):
            place = r.sequence_id * 8 + r.offset + j
            assert place not in found
            found[place] = (r.doc_id, r.start + j)
    assert found == {place: queues[q][k] for place, (q, k) in enumerate(stream)}


def test_the_pipeline_packs_all_it_is_given(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(packing, "LEVEL", 4)
    docs = [(k, "one two three four five " * (k % 60), "en", "abc"[k % 3], k) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    held, ids, windows = Counter(), {}, Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, frame, "").collect():
        held[r.doc_id] += r.length
        ids[r.doc_id] = r.doc_tokens
        windows[r.sequence_id] += r.length
    assert ids.keys() == {k for k, *_ in docs} and held == ids
    assert sorted(windows) == list(range(len(windows))) and len(windows) > 2 * packing.LEVEL
    assert all(n == packing.WINDOW for k, n in windows.items() if k < len(windows) - 1)


def test_no_join_over_rounds_is_broadcast(spark):
    queues = spark.createDataFrame([("=a", 10**6, 65536, 244)], "queue string, total long, weight long, last long")
    laid = packing.placed(packing.rounds_of(queues, packing.WINDOW), packing.WINDOW)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    docs = spark.createDataFrame([(k, "some words", "a") for k in range(9)], "doc_id long, text string, source string")
    plan = packing.pack(docs)._jdf.queryExecution().executedPlan().toString()
    # Only places of queue parts may be: a row for each input partition and source, of a written frame.
    assert plan.count("BroadcastHashJoin") <= 1 and "BroadcastNestedLoopJoin" not in plan
