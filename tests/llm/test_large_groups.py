"""Few pairs of large groups."""

from __future__ import annotations

import random

from tallywork.llm import linking


def test_pairs_of_large_groups_grow_with_members(spark):
    r = random.Random(3)
    first = range(linking.SMALL_GROUP)
    rows = [(k, c) for k in range(60) for c in (*first, *r.sample(range(8, 400), 40))]
    rows += [(1000 + i, c) for i in range(20) for c in (i, 400 + i)]
    pairs, large = linking.key_pairs(spark.createDataFrame(rows, "k long, c long"), fewer=True)
    found = [tuple(x) for x in pairs.collect()]
    assert len(found) == len(set(found)) <= 28 + 2 * 400 + 20
    assert {(i, 400 + i) for i in range(20)} | {(a, b) for b in first for a in range(b)} <= set(found)
    assert {b for _, b in found} >= {c for k, c in rows if k < 60 and c}
    assert {tuple(x) for x in large.collect()} == {(k, c) for k, c in rows if k < 60}
    together = {k: {c for g, c in rows if g == k} for k in range(60)}
    assert all(a < b and any({a, b} <= t for t in together.values()) for a, b in found if b < 400)


def test_all_pairs_of_stars_and_chains_otherwise(spark):
    rows = [(k, c) for k in range(2) for c in range(k, 40, 1 + k)]
    pairs, _ = linking.key_pairs(spark.createDataFrame(rows, "k long, c long"))
    wanted = set()
    for k in range(2):
        group = [c for g, c in rows if g == k]
        wanted |= {(a, b) for b in group[:8] for a in group[:8] if a < b}
        wanted |= {p for x, b in zip(group[7:], group[8:], strict=False) for p in ((x, b), (group[0], b))}
    assert sorted(map(tuple, pairs.collect())) == sorted(wanted)
