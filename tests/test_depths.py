"""Depth from the ends of spans against counting every base."""

import random
from collections import Counter
from itertools import groupby

import pytest

from strandloom.sources import readers


@pytest.mark.parametrize("seed", range(2))
def test_intervals_as_bases(spark, seed):
    rng = random.Random(seed)
    names = ["hot", "hot", "hot", "a", "b", None, "z"]
    spans = [(n, s := rng.randint(0, 60) * (1 + 40 * (n == "z")), s + rng.randint(-2, 9)) for n in rng.choices(names, k=300)]
    bases = Counter((n, p) for n, s, e in spans for p in range(s, e + 1))
    df = spark.createDataFrame(spans, "name string, start long, end long")
    got = readers.depth_intervals(df).collect()
    assert Counter({(r["name"], p): r["depth"] for r in got for p in range(r["first"], r["last"] + 1)}) == bases
    touching = {(r["name"], r["last"] + 1): r["depth"] for r in got}
    assert all(touching.get((r["name"], r["first"])) != r["depth"] for r in got)  # none could be longer
    longest = {}
    for n in set(names):
        at = sorted(p for m, p in bases if m == n)
        runs = [[p for _, p in g] for _, g in groupby(enumerate(at), lambda x: x[1] - x[0])]
        if runs:
            best = max(runs, key=lambda r: (len(r), -r[0]))
            longest[n] = (best[0], best[-1])
    assert {r["name"]: (r["first"], r["last"]) for r in readers.longest_covered_parts(df).collect()} == longest


def test_long_references_take_a_row_per_change(spark):
    df = spark.createDataFrame([("c", 0, 10**12), ("c", 5, 10**11), ("d", 3, 3), ("e", 4, 3)], "name string, start long, end long")
    assert sorted(map(tuple, readers.depth_intervals(df).collect())) == [("c", 0, 4, 1), ("c", 5, 10**11, 2), ("c", 10**11 + 1, 10**12, 1), ("d", 3, 3, 1)]
    assert readers.depth_intervals(df.limit(0)).count() == 0
