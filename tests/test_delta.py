"""Deltas give back the exact bytes, and tell few of them."""

import random

import pytest

from cycle_analytics.operators import delta

BLOCK, PART = 16, 64


def apply_by_hand(old, told, new):
    out = b""
    for _, length, source in told:
        out += old[source : source + length] if source is not None else new[len(out) : len(out) + length]
    return out


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(1)
    text = lambda n, letters=256: bytes(draw.randrange(letters) for _ in range(n))
    base = text(1000)
    moved = base[640:] + base[:640]
    period, stretches = text(23) * 40, b"".join(text(size) * (190 // size) for size in (5, 6, 7, 11, 13, 3, 9, 10) * 3)
    return {
        "same": (base, base), "inserted": (base, base[:333] + b"!" + base[333:]), "cut": (base, base[100:]),
        "moved": (base, moved), "empty": (base, b""), "from nothing": (b"", base), "short": (b"abc", b"abcd"),
        "zeros": (bytes(500), bytes(701)), "few letters": (text(800, 2), text(800, 2)), "periodic": (period, period[7:] + b"x" + period),
        "stretches": (stretches, stretches[10:]), "doubled": (base, base + base), "other": (base, text(900)),
    }


def test_rolled_checksums_do_not_depend_on_the_place():
    draw = random.Random(2)
    data = bytes(draw.randrange(256) for _ in range(300))
    rolled = delta.rolled(data, 32)
    assert len(rolled) == 269 and all(rolled[k] == delta.rolled(data[k : k + 32], 32)[0] for k in range(269))
    assert len(delta.rolled(b"ab", 32)) == 0


def test_deltas_replay_to_the_exact_bytes(spark, cases):
    files = spark.createDataFrame([(k, old, new) for k, (old, new) in cases.items()], "name string, old binary, new binary")
    blocks, parts = delta.old_blocks(files, "name", "old", BLOCK), delta.new_parts(files, "name", "new", BLOCK, PART)
    told = delta.instructions(blocks, parts, BLOCK)
    found = {name: [] for name in cases}
    for row in told.collect():
        found[row.key].append((row.place, row.length, row.source))
    literal = {}
    for name, (old, new) in cases.items():
        steps = sorted(found[name])
        assert [s[0] for s in steps] == [sum(x[1] for x in steps[:k]) for k in range(len(steps))], name
        assert apply_by_hand(old, steps, new) == new, name
        literal[name] = sum(n for _, n, source in steps if source is None)
    assert literal["same"] == 1000 % BLOCK and literal["inserted"] <= 3 * BLOCK and literal["cut"] <= 2 * BLOCK
    assert literal["moved"] <= 3 * BLOCK and literal["zeros"] < BLOCK and literal["other"] == 900 and literal["doubled"] <= 2 * BLOCK
    # Every place counts where bytes repeat, so a cut costs no more there: a look at all places one by one gives the same.
    old, new = cases["stretches"]
    held, at, plain = {old[k : k + BLOCK] for k in range(0, len(old) - BLOCK + 1, BLOCK)}, 0, 0
    while at < len(new):
        known = new[at : at + BLOCK] in held
        at, plain = (at + BLOCK, plain) if known else (at + 1, plain + 1)
    assert literal["stretches"] == plain
    assert literal["periodic"] <= 4 * BLOCK and literal["empty"] == 0 and literal["from nothing"] == 1000
    assert len(found["same"]) == 2  # one copy that was joined, and the rest
    stored = delta.with_literals(told, parts, PART)
    back = {name: {} for name in cases}
    for row in delta.replayed(stored, blocks, BLOCK).collect():
        back[row.key][row.place] = bytes(row.data)
    assert {n: b"".join(v for _, v in sorted(p.items())) for n, p in back.items()} == {n: new for n, (_, new) in cases.items()}
