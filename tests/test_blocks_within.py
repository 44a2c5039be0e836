"""Blocks that stand in longer ones, by runs and by the index, against comparing all."""

import random

from strandloom.operators import filters


def test_blocks_in_longer_ones(spark, monkeypatch):
    rng = random.Random(4)
    blocks = [[rng.choice(["a", "b", "c", None]) for _ in range(rng.choice((0, 1, 2, 4, 6, 9)))] for _ in range(60)] + [["aa", ""], ["a", "a"], None]

    def inside(x, y):
        return len(x) < len(y) and any(y[i : i + len(x)] in (x, x[::-1]) for i in range(len(y) - len(x) + 1))

    df = spark.createDataFrame([(b,) for b in blocks], "block array<string>")
    full = [b for b in blocks if b]
    wanted = {min(str(b), str(b[::-1])) for b in full if not any(inside(b, o) for o in full)} | {"None", "[]"}
    for most in (32, 4, 1):
        monkeypatch.setattr(filters, "SHORT_BLOCK", most)
        got = [r.block for r in filters.maximal_blocks(df).collect()]
        told = {str(b) if not b else min(str(b), str(b[::-1])) for b in got}
        assert told == wanted and len(got) == len(told)


def test_blocks_without_an_index(spark, monkeypatch):
    monkeypatch.setattr(filters, "suffix_index", lambda *_: (_ for _ in ()).throw(AssertionError("indexed")))
    df = spark.createDataFrame([(["a", "b", "c"],), (["c", "b"],), (["d"],)], "block array<string>")
    assert filters.maximal_blocks(df).count() == 2
