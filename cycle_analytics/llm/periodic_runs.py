"""Periodic runs of words, found by recursive frequency splitting and a scan of lags.

A run is a maximal stretch of words with smallest period q and at least max(`least`, `power` * q) words. Every word
of a run occurs `power` times in it, so a word that occurs more rarely in its segment is in no run of that segment:

1. All texts of a slice are coded as numbers. A segment is a text at first. Words that are too rare within their
   segment split it, pieces too short for a run go, and the pieces are counted anew until nothing splits.
2. Segments that stay are scanned lag by lag. A run of period q has max(least, power * q) - q places in a row that
   equal the place q later, so probing every so many places meets each run: n / 3 * ln(n) probes of a segment of n
   words. Probes whose neighbours differ too are dropped at once, the rest is extended in both directions.
3. Periods ascend. A probe inside a run whose period divides the lag would only find that run again, and is skipped;
   what is left has its smallest period (`power` is 2 or more, so a smaller one would divide it).

Words are what `[^\\x20\\x09-\\x0D]+` matches. Null, empty and blank texts have no words, no runs and an empty collapsed
text. Rows are judged one by one: repeated rows alike, null ids too. A long text is coded piece by piece and held as
four bytes a word and its distinct words. Extra columns are left alone. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import BLANK_RUN, only, slices

LEAST_WORDS = 6
POWER = 4
PIECE = 1 << 20
PROBES = 1 << 20
RUN = "struct<start: long, length: long, period: long>"
SCHEMA = "id {kind}, n_words long, runs array<" + RUN + ">, collapsed string"


def coded(data: bytes, code) -> np.ndarray:
    """The words of a text as numbers. The text is split piece by piece, at blanks."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(code, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def segments(codes: np.ndarray, owner: np.ndarray, least: int, power: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches that recursive splitting leaves. `owner` ascends: the text of each word."""
    found, place, seg = [], np.arange(len(codes)), owner.astype(np.int64)
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(place):
        _, which, times = np.unique(seg * width + codes[place], return_inverse=True, return_counts=True)
        stays = times[which] >= power
        split = np.zeros(int(seg[-1]) + 1, bool)
        split[seg[~stays]] = True
        whole = ~split[seg]
        if whole.any():
            done = place[whole]
            turns = np.nonzero(np.diff(seg[whole]))[0] + 1
            firsts = np.concatenate([[0], turns, [len(done)]])
            found += [(int(done[a]), int(done[b - 1]) + 1) for a, b in zip(firsts, firsts[1:]) if b - a >= least]
        stays &= ~whole
        place, seg = place[stays], seg[stays]
        if len(place):
            seg = np.concatenate([[0], np.cumsum((np.diff(place) != 1) | (np.diff(seg) != 0))])
            long = np.bincount(seg)[seg] >= least
            place, seg = place[long], seg[long]
    return sorted(found)


def reach(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many places in a row x[a], x[a + step], ... equal x[b], x[b + step], ..."""
    room = len(x) - max(a, b) if step > 0 else min(a, b) + 1
    done, size = 0, 32
    while done < room:
        n = min(size, room - done)
        if step > 0:
            same = x[a + done : a + done + n] == x[b + done : b + done + n]
        else:
            same = (x[a - done - n + 1 : a - done + 1] == x[b - done - n + 1 : b - done + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + n, size * 2
    return done


def probes(x: np.ndarray, least: int, power: int) -> Iterator[tuple[list[int], list[int]]]:
    """(lags, places) that may lie in a run, lags ascending, places ascending per lag."""
    n, top = len(x), len(x) // power
    lags = np.arange(1, top + 1)
    lags = lags[np.maximum(least, power * lags) <= n]
    row = np.maximum(least, power * lags) - lags  # equal places in a row that a run has
    counts = -(-(n - lags) // row)
    ends = np.cumsum(counts)
    first = 0
    while first < len(lags):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PROBES, "right")))
        q, m, times = lags[first:last], row[first:last], counts[first:last]
        lag, gap = np.repeat(q, times), np.repeat(m, times)
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(times) - times, times)) * gap
        hit = x[place] == x[place + lag]
        lag, gap, place = lag[hit], gap[hit], place[hit]
        right, left = np.ones(len(lag), bool), np.ones(len(lag), bool)
        # One side of the place holds half of the row at least.
        for part in (1, 2, 3, gap // 4, gap // 2):
            t = np.minimum(part, gap // 2)
            right &= (place + lag + t < n) & (x[np.minimum(place + t, n - 1)] == x[np.minimum(place + lag + t, n - 1)])
            left &= (place - t >= 0) & (x[np.maximum(place - t, 0)] == x[np.maximum(place + lag - t, 0)])
        near = right | left
        yield lag[near].tolist(), place[near].tolist()
        first = last


def scan(x: np.ndarray, least: int = LEAST_WORDS, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    lag_now, beyond, dividing = 0, 0, []
    for lags, places in probes(x, least, power):
        for q, j in zip(lags, places):
            if q != lag_now:
                lag_now, beyond = q, 0
                dividing = [runs for p, runs in found.items() if q % p == 0]
            if j < beyond:
                continue
            if any((k := bisect_right(starts, j)) and j + q < ends[k - 1] for starts, ends in dividing):
                continue
            left, beyond = reach(x, j, j + q, -1) - 1, j + reach(x, j, j + q, 1)
            start, end = j - left, beyond + q
            if end - start >= max(least, power * q):
                starts, ends = found.setdefault(q, ([], []))
                starts.append(start)
                ends.append(end)
    return sorted((s, e - s, q) for q, (starts, ends) in found.items() for s, e in zip(starts, ends))


def runs_of(codes: list[np.ndarray], least: int, power: int) -> list[list[tuple[int, int, int]]]:
    """The runs of every text of a slice, in order of start and period."""
    sizes = [len(c) for c in codes]
    out: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    if not sum(sizes):
        return out
    flat, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    for first, end in segments(flat, owner, least, power):
        text = int(owner[first])
        shift = first - int(begins[text])
        out[text] += [(shift + s, n, q) for s, n, q in scan(flat[first:end], least, power)]
    return [sorted(runs) for runs in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, power: int = POWER
) -> DataFrame:
    """id, n_words, runs (start, length, period), collapsed: the words that stay, joined by one space."""
    if power < 2:
        raise ValueError("a run repeats its period twice at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                numbers: defaultdict[bytes, int] = defaultdict()
                numbers.default_factory = numbers.__len__
                codes = [coded((text or "").encode(), numbers.__getitem__) for text in batch.column(1).to_pylist()]
                words = list(numbers)
                runs = runs_of(codes, least, power)
                joined = []
                for code, its in zip(codes, runs):
                    left = code[kept_words(len(code), its)] if its else code
                    joined.append(b" ".join(map(words.__getitem__, left.tolist())).decode())
                named = [[{"start": s, "length": n, "period": q} for s, n, q in its] for its in runs]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(c) for c in codes], pa.int64()), pa.array(named, kind), pa.array(joined, pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)


def looped(text: Column, number: Column) -> Column:
    """The query's texts: one in ten, by the checksum of its number, repeats a stretch up to its end."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")
    h = F.crc32(number.cast("string"))
    n, g = F.size(words), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # A row of finished values: a lambda must not compute them anew for every word.
    made = F.transform(
        F.array(F.struct(words.alias("w"), n.alias("n"), a.cast("int").alias("a"), p.cast("int").alias("p"))),
        lambda r: F.array_join(
            F.transform(
                F.sequence(F.lit(0), r["n"] - 1),
                lambda i: F.get(r["w"], F.when(i < r["a"], i).otherwise(r["a"] + (i - r["a"]) % r["p"])),
            ),
            " ",
        ),
    )[0]
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def run_query(docs: DataFrame) -> DataFrame:
    texts = only(docs, "doc_id", "text")
    found = periodic_runs(texts.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    told = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"), F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
