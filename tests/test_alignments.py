"""Alignments and common runs in batches against one pair after another."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignments
from strandloom.functions.arrays import align, longest_common_run


def pairs(seed, n, longest):
    rng = random.Random(seed)
    one = lambda: ["+" + rng.choice("abc") for _ in range(rng.randint(0, longest))]
    out = [(one(), one()) for _ in range(n)]
    return out + out[:5] + [([], []), ([], ["+a"]), (["+a"], []), (["+a"] * longest, ["+a"] * longest)]


@pytest.mark.parametrize("seed,longest,cells", [(1, 6, 4_000_000), (2, 9, 60), (3, 3, 1)])
def test_as_one_by_one(monkeypatch, seed, longest, cells):
    monkeypatch.setattr(alignments, "CELLS", cells)
    rows = pairs(seed, 300, longest)
    x, y = (pa.array([r[z] for r in rows], pa.list_(pa.string())) for z in (0, 1))
    x, y = x.slice(2), y.slice(2)
    got = [[(c["a"], c["b"]) for c in aln] for aln in alignments.align_batch(x, y).to_pylist()]
    assert got == [align(a, b) for a, b in rows[2:]]
    for r, (a, b) in zip(alignments.common_run_batch(x, y).to_pylist(), rows[2:], strict=True):
        assert (r["run"], (r["a_start"], r["a_end"]), (r["b_start"], r["b_end"])) == longest_common_run(a, b)


def test_as_columns_and_without_rows(spark):
    rows = pairs(4, 50, 7)
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    got = df.select("x", "y", alignments.align_udf("x", "y").alias("aln"), alignments.common_run_udf("x", "y").alias("r")).collect()
    assert len(got) == len(rows) and all([tuple(c) for c in r["aln"]] == align(r["x"], r["y"]) and r["r"]["run"] == longest_common_run(r["x"], r["y"])[0] for r in got)
    assert df.limit(0).select(F.size(alignments.align_udf("x", "y"))).collect() == []
