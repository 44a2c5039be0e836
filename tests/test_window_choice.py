"""All window lengths at once against one graph after another."""

import random

from strandloom.operators import filters, graph
from strandloom.plans import window_choice
from strandloom.plans.components import component_numbers

GENES = ["g1", "g2"]


def test_as_one_graph_after_another(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", [rng.choice("+-") + f"g{rng.randint(10 * (i % 4), 10 * (i % 4) + 5)}" for _ in range(rng.randint(1, 9))]) for i in range(60)]
    reads = graph.as_reads(spark.createDataFrame(rows, "read_id string, calls array<string>"))
    got = {}
    for r in window_choice.validity_by_k(reads, (3, 5, 7), GENES).collect():
        got.setdefault(r["k"], []).append(r["valid"])
    for k in (3, 5, 7):
        g = graph.build_graph(reads, k).stored()
        told = filters.component_is_valid(g.reads, component_numbers(g), g.read_nodes, GENES, k)
        assert sorted(got[k]) == sorted(r["valid"] for r in told.collect())


def test_the_largest_k_before_a_bad_one(spark):
    told = spark.createDataFrame([(3, 1, True), (5, 2, True), (7, 3, True), (7, 4, False), (9, 5, True)], "k int, component long, valid boolean")
    assert window_choice.largest_valid(told, (3, 5, 7, 9)) == 5
    assert window_choice.largest_valid(told.filter("k = 7"), (7, 9)) == 7
    assert window_choice.largest_valid(told.limit(0), (3, 5)) == 5


def test_only_windows_seen_again_are_links(spark, monkeypatch):
    """Before, each window of a read was a link, though most of many calls are seen once."""
    asked = []
    monkeypatch.setattr(window_choice, "label_components", lambda nodes, links, f=window_choice.label_components: asked.append(links.count()) or f(nodes, links))
    rows = [(f"r{i}", [f"+g{i}_{j}" for j in range(6)]) for i in range(5)] + [("s", ["+g0_1", "+g0_2", "+g0_3"])]
    reads = graph.as_reads(spark.createDataFrame(rows, "read_id string, calls array<string>"))
    parts = {r.read_id: r.component for r in window_choice.read_components(reads, (3,)).collect()}
    assert asked == [1] and parts["s"] == parts["r0"] and len(set(parts.values())) == 5
