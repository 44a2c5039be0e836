"""Windows are cut no more often than needed."""

import random

from strandloom.operators import filters, graph


def _cuts(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")


def _graph(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", [rng.choice("+-") + rng.choice("abcdef") for _ in range(rng.randint(2, 7))]) for i in range(40)]
    return rows, graph.build_graph(spark.createDataFrame(rows, "read_id string, calls array<string>"), 3)


def _walks(g):
    out = {}
    for r in g.read_nodes.collect():
        out.setdefault(r.read_id, []).append((r.pos, r.node_id))
    return out


def test_nodes_of_reads_does_not_count_nodes(spark):
    rows, g = _graph(spark)
    found = graph.nodes_of_reads(g, spark.createDataFrame([(f"r{i}",) for i in range(0, 40, 3)], "read_id string"))
    assert _cuts(found) == 1
    wanted = {(f"r{i}", p, n) for i in range(0, 40, 3) for p, n in _walks(g).get(f"r{i}", [])}
    assert {(r.read_id, r.pos, r.node_id) for r in found.collect()} == wanted
    gone = g.nodes.orderBy("node_id").limit(10)
    lost = {r.node_id for r in gone.collect()}
    cut = graph.nodes_of_reads(filters.remove_nodes(g, gone), g.reads)
    assert {(r.read_id, r.pos) for r in cut.collect()} == {(i, p) for i, w in _walks(g).items() for p, n in w if n not in lost}


def test_relevance_trim_cuts_windows_once(spark):
    rows, g = _graph(spark)
    found = filters.relevance_trim(g, ["a", "b"]).nodes
    assert _cuts(found) == 1
    hot = {i for i, w in _walks(g).items() for _, n in w if {"a", "b"} & {x[1:] for x in n.split("~~~")}}
    assert {r.node_id for r in found.collect()} == {n for i in hot for _, n in _walks(g)[i]}


def test_whole_graphs_are_not_filtered(spark, sf, monkeypatch):
    from strandloom.plans import path_queries

    monkeypatch.setattr(filters, "filter_graph", lambda *_: (_ for _ in ()).throw(AssertionError("filtered")))
    assert path_queries._orders(spark, sf, 1).nodes.filter("coverage < 1").isEmpty()


def test_bubble_pop_corrects_reads_once(spark, sf, monkeypatch):
    from strandloom.operators import correct
    from strandloom.plans import path_queries

    seen = []
    monkeypatch.setattr(correct, "pop_bubbles", lambda g, *_: seen.append(g) or g.reads)
    path_queries.bubble_pop(spark, sf)
    made = [t._jdf.queryExecution().optimizedPlan().toString() for t in (seen[0].reads, seen[0].read_nodes, seen[0].nodes, seen[0].edges)]
    assert not any("MapIn" in plan for plan in made)
