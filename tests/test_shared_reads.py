"""Nodes that share reads, with and without long reads, against counting all pairs."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest

from strandloom.operators import filters, graph


def brute(reads, least):
    n = Counter((a, b) for nodes in reads.values() for a in set(nodes) - {None} for b in set(nodes) - {None})
    return {p: c for p, c in n.items() if c >= least}


def graph_of(spark, reads):
    rows = [(r, i, x) for r, nodes in reads.items() for i, x in enumerate(nodes)]
    return SimpleNamespace(read_nodes=spark.createDataFrame(rows, "read_id string, pos int, node_id string"))


@pytest.mark.parametrize("seed,least,longest", [(1, 1, 4), (2, 2, 4), (3, 3, 6), (4, 2, 2000)])
def test_as_all_pairs(spark, monkeypatch, seed, least, longest):
    monkeypatch.setattr(filters, "LONG_READ", longest)
    rng = random.Random(seed)
    reads = {f"r{i}": [rng.choice([*"abcdefghijk", None]) for _ in range(rng.choice((2, 3, 12, 30)))] for i in range(30)}
    reads["x1"] = reads["x2"] = list("uvwxyz")
    got = {(r["a"], r["b"]): r["n"] for r in filters.shared_reads(graph_of(spark, reads), least).collect()}
    assert got == brute(reads, least) and len(got) > 20


def test_a_very_long_read_makes_no_pairs_of_its_own(spark):
    long = spark.range(100_000).selectExpr("'long' as read_id", "cast(id as int) as pos", "concat('n', id) as node_id")
    others = spark.range(3000).selectExpr("concat('r', id div 3) as read_id", "cast(id % 3 as int) as pos", "concat('n', id * 7) as node_id")
    second = spark.range(3).selectExpr("'second' as read_id", "cast(id as int) as pos", "concat('n', id) as node_id")
    g = SimpleNamespace(read_nodes=long.union(others).union(second))
    got = filters.shared_reads(g, 2)
    assert got.filter("a = b").count() == 3002 and got.filter("a <> b").count() == 1000 * 6 + 6


def test_shared_reads_pair_numbers(spark):
    """Before, pairs of names were counted, each both ways."""
    rng = random.Random(5)
    rows = [(f"r{i}", [rng.choice("+-") + rng.choice("abcd") for _ in range(9)]) for i in range(60)]
    g = graph.build_graph(spark.createDataFrame(rows, "read_id string, calls array<string>"), 3)
    found = filters.shared_reads(g, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    seen = {}
    for r in g.read_nodes.collect():
        seen.setdefault(r.node_id, set()).add(r.read_id)
    wanted = {(a, b, len(x & y)) for a, x in seen.items() for b, y in seen.items() if len(x & y) >= 2}
    assert {tuple(r) for r in found.collect()} == wanted and wanted
