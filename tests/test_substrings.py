"""Texts and their parts by q-grams against looking at all pairs."""

import random

from strandloom.operators.substrings import containing
from strandloom.sources.readers import attach_promoters


def test_as_all_pairs(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(80)} | {"", "aaaaaaaaaaaa", None}
    parts = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(80)} | {"", "aaaaa", "zzzz", None}
    parts |= {t[2:9] for t in sorted(t for t in texts if t)[:20]}
    got = containing(spark.createDataFrame([(t,) for t in texts] * 2, "text string"), spark.createDataFrame([(p,) for p in parts] * 2, "part string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((t, p) for t in texts - {None} for p in parts - {None} if p in t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_short_or_no_parts(spark):
    texts = spark.createDataFrame([("ab",), ("b",)], "text string")
    assert sorted(map(tuple, containing(texts, spark.createDataFrame([("b",), ("ab",)], "part string")).collect())) == [("ab", "ab"), ("ab", "b"), ("b", "b")]
    assert containing(texts, spark.createDataFrame([], "part string")).count() == 0


def test_promoters_go_to_all_genes_that_hold_their_name(spark):
    genes = spark.createDataFrame([("blaTEM-1",), ("TEM",), ("ompK",)], "gene string")
    promoters = spark.createDataFrame([("TEM_promoter", "a", "AC"), ("TEM_Promoter", "b", "GT"), ("promoter", "c", "TT")], "gene string, allele string, sequence string")
    got = sorted(map(tuple, attach_promoters(genes, promoters).collect()))
    assert got == sorted([(g, a, s) for g in ("blaTEM-1", "TEM") for a, s in (("a", "AC"), ("b", "GT"))] + [(g, "c", "TT") for g in ("blaTEM-1", "TEM", "ompK")])
