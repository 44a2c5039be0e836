import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import filters, graph, paths, sketch
from strandloom.operators.correct import correct_reads, popped, repair
from strandloom.plans.components import component_numbers, label_components
from tests import serial_bubbles, serial_paths


def reads(spark, *lines, positions=None):
    rows = [(f"read{i}", line.split(), positions) for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, graph.READS)


def test_two_reads(spark):
    g = graph.build_graph(reads(spark, "+gene1 -gene2 +gene3 -gene4", "+gene1 -gene2 +gene3 -gene5"), 3)
    assert sorted(r["coverage"] for r in g.nodes.collect()) == [1, 1, 2] and g.edges.count() == 4


def test_filtering_keeps_the_strong_part(spark):
    one = " ".join(f"{'+-'[i % 2]}gene{i}" for i in range(1, 9))
    g = graph.build_graph(reads(spark, one + " +gene20 -gene21", one), 3)
    out = filters.filter_graph(g, 2, 2)
    assert out.nodes.count() == 6 and out.edges.count() == 10
    assert filters.reads_to_correct(out).collect() == [("read1",)]
    again = filters.filter_graph(out, 2, 2)
    assert again.nodes.count() == 6 and again.edges.count() == 10


def test_even_windows_are_refused(spark):
    with pytest.raises(ValueError, match="odd"):
        graph.build_graph(reads(spark, "+a +b"), 2)


def test_a_read_may_be_turned(spark):
    line = "+a -b +c +d -e +a +c"
    turned = " ".join(("-" if c[0] == "+" else "+") + c[1:] for c in reversed(line.split()))
    a, b = (graph.build_graph(reads(spark, x), 3) for x in (line, turned))
    rows = lambda g: sorted(map(tuple, g.nodes.select("node_id", "coverage").collect()))
    edges = lambda g: sorted(map(tuple, g.edges.select("src", "src_dir", "tgt", "tgt_dir", "coverage").collect()))
    assert rows(a) == rows(b) and edges(a) == edges(b)
    e = set(edges(a))
    assert all((t, -td, s, -sd, c) in e for s, sd, t, td, c in e)


def test_short_reads_and_totals(spark):
    g = graph.build_graph(reads(spark, "+a +b", "+a +b +c +d"), 3)
    assert [r["read_id"] for r in graph.short_reads(g).collect()] == ["read1"]
    assert tuple(graph.graph_totals(g).first()) == (2, 2, 2)
    assert {r["read_id"] for r in filters.valid_reads(g).collect()} == {"read1", "read2"}
    assert graph.get_node(g, ["-c", "-b", "-a"]).count() == 1
    with pytest.raises(Exception, match="no such node"):
        graph.get_node(g, ["+x", "+y", "+z"]).collect()


def test_collapsed_edges(spark):
    r = reads(spark, "+a +b", "-a -b")
    assert graph.build_graph(r, 1).edges.count() == 4 and graph.build_graph(r, 1, "collapsed").edges.count() == 2


def test_merging_adds_coverage(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d"), 3)
    m = graph.merge_graphs([g, g])
    assert {r["coverage"] for r in m.nodes.collect()} == {2} and {r["coverage"] for r in m.edges.collect()} == {2}


def test_components_are_numbered_by_first_sight(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d", "+p +q +r +s", "+d +e +f", "+b +c +d +e"), 3)
    numbers = {r["node_id"]: r["component"] for r in component_numbers(g).collect()}
    assert numbers["+a~~~+b~~~+c"] == numbers["+b~~~+c~~~+d"] == 1 and numbers["+p~~~+q~~~+r"] == 2 and max(numbers.values()) == 3
    strong = filters.strong_components(g, component_numbers(g), 2)
    assert strong.nodes.count() == 3


def test_tips_are_removed_but_not_whole_components(spark):
    # Two tips of three nodes go; the two nodes of the third read are a component of their own.
    g = graph.build_graph(
        reads(
            spark,
            "-gene6 +gene10 +gene9 -gene6 +gene3 -gene7 +gene5 -gene6 +gene3 -gene7 -gene6 +gene3 -gene7 +gene3 -gene4 +gene5 +gene3 -gene4 +gene5 +gene3 -gene4 +gene5",
            "+gene9 -gene6 +gene7 +gene3 -gene4 +gene5",
            "-gene0 +gene1 -gene2 +gene3",
        ),
        3,
    )
    gone = {r["node_id"] for r in paths.tips(g, 4).collect()}
    assert len(gone) == 6 and not any("gene0" in n or "gene1~" in n for n in gone)


def test_unitigs_of_a_line(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d +e", "+a +b +c +d +e"), 3)
    got = [(r["genes"], r["n_reads"]) for r in paths.unitigs(g).collect()]
    assert got == [(["+a", "+b", "+c", "+d", "+e"], 2)]


def brute_junction_paths(g, most):
    """All walks between branching sides by depth-first search, without those that contain a shorter one."""
    out, coverage = {}, {r["node_id"]: r["coverage"] for r in g.nodes.collect()}
    for e in g.edges.collect():
        out.setdefault((e["src"], e["src_dir"]), []).append((e["tgt"], e["tgt_dir"]))
    starts = {s for s, ways in out.items() if len(ways) > 1}
    pairs = {}

    def go(path):
        node, way = path[-1]
        if len(path) > 1 and (node, -way) in starts:
            pairs.setdefault((path[0], (node, -way)), []).append(tuple(path))
        if len(path) < most:
            for step in out.get((node, way), ()):
                if step[0] not in {n for n, _ in path}:
                    go([*path, step])

    for s in starts:
        go([s])
    found = {min(p, tuple((n, -d) for n, d in reversed(p))) for ways in pairs.values() if len(ways) > 1 for p in ways}
    ids = {p: [n for n, _ in p] for p in found}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    short = [p for p in found if not any(len(q) < len(p) and (inside(ids[q], ids[p]) or inside(ids[q][::-1], ids[p])) for q in found)]
    return {",".join(ids[p]): sum(coverage[n] for n in ids[p][1:-1]) / (len(p) - 2) for p in short if len(p) > 2}


BUBBLES = ("+a +b +c +x1 +x2 +x3 +d +e +f", "+a +b +c +y1 -y2 +d +e +f +g", "-f -e -d +y2 -y1 -c -b -a", "+c +x1 +x2 +x3 +d +q +r +s", "+k +l +m +n +o", "+l +m +u +n +o +p")


@pytest.mark.parametrize("most", [6, 9, 12])
def test_junction_paths_against_a_search(spark, most):
    g = graph.build_graph(reads(spark, *BUBBLES), 3).stored()
    expected = brute_junction_paths(g, most)
    got = {r["p"]: r["coverage"] for r in paths.junction_paths(g, most).select(F.array_join("path.node_id", ",").alias("p"), "coverage").collect()}
    assert got == expected and (len(got) >= 2 or most < 9)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_a_search(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 420)] + [(i, i + 1) for i in range(500, 640)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    least = {}
    for x in list(up):
        least[find(x)] = min(least.get(find(x), x), x)
    nodes = spark.createDataFrame([(x,) for x in range(700)], "node_id long")
    got = {r["node_id"]: r["label"] for r in label_components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: least[find(x)] if x in up else x for x in range(700)}


def test_merging_counts_a_read_once(spark):
    one, two = reads(spark, "+a +b +c +d"), reads(spark, "+a +b +c +e", "+b +c +d")
    m = graph.merge_graphs([graph.build_graph(one, 3), graph.build_graph(two, 3)])
    told = {r["node_id"]: (r["coverage"], r["n_reads"]) for r in m.nodes.collect()}
    assert told == {"+a~~~+b~~~+c": (2, 1), "+b~~~+c~~~+d": (2, 2), "+b~~~+c~~~+e": (1, 1)}
    assert sorted((r["read_id"], r["node_id"]) for r in m.read_nodes.collect()) == [("read1", "+a~~~+b~~~+c"), ("read1", "+b~~~+c~~~+e"), ("read2", "+b~~~+c~~~+d")]


def test_the_weakest_node_goes(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d", "+a +b +c +d", "+b +c +d +e", "+p +q +r"), 3).stored()
    shared, nodes = filters.shared_reads(g), graph.node_numbers(g)
    below = {r["node_id"]: r["below"] for r in filters.removal_order(shared, nodes, 2).collect()}
    assert below == {"+a~~~+b~~~+c": 2, "+b~~~+c~~~+d": 2, "+c~~~+d~~~+e": 4, "+p~~~+q~~~+r": 4}
    assert filters.weakest_node(shared, nodes, 2).collect() == [("+c~~~+d~~~+e",)]
    left = filters.intersection_filter(shared, nodes, 2).collect()
    assert len(left) == shared.count() - 3 and not any("+e" in r["a"] + r["b"] for r in left)
    assert filters.weakest_node(shared.limit(0), nodes.limit(0), 2).count() == 0


PLACES = [(2 * i, 2 * i + 1) for i in range(10)]
LINE = "+gene1 -gene2 +gene3 -gene4 +gene5 -gene6 +gene5 +gene9 -gene10 +gene11"


def test_alleles_of_a_line(spark):
    g = graph.build_graph(reads(spark, LINE, LINE, LINE, positions=PLACES), 3)
    rows = paths.assign_alleles(g, ["gene5"], 20.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["allele"], set()).add((r["read_id"], r["start"], r["end"]))
    assert sorted(map(sorted, by.values())) == [[(f"read{i}", s, s + 1) for i in (1, 2, 3)] for s in (8, 12)]


def test_subsets(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d +e", "+a +b +c +x +y"), 3).stored()
    every = g.nodes.select("node_id")
    told = {r["node_id"]: (r["anchor"], r["junction"]) for r in paths.subset_anchors(g, every).collect()}
    assert told["+a~~~+b~~~+c"] == (True, True) and told["+b~~~+c~~~+d"] == (False, False)
    ends = paths.subset_anchors(g, every).filter("anchor")
    assert sorted(len(r["path"]) for r in paths.paths_between(g, every, ends, 5).collect()) == [3, 3]
    walks = graph.walks_of(g).select("read_id", F.col("walk.node_id").alias("items"))
    got = paths.anchor_suffixes(walks, "+a~~~+b~~~+c", every).collect()
    assert sorted(r["n_reads"] for r in got) == [1, 1]


def test_a_component_without_alleles_gets_one(spark):
    g = graph.build_graph(reads(spark, LINE, LINE, "+p -q +gene5 +r", positions=PLACES), 3).stored()
    none = spark.createDataFrame([(1, "gene5", "gene5_1", "read1", 8, 9)], "component long, gene string, allele string, read_id string, start int, end int")
    from strandloom.plans.components import component_numbers as parts

    got = paths.missed_alleles(g, ["gene5"], parts(g), none).collect()
    assert [tuple(r) for r in got] == [(2, "gene5", "gene5_2", "read3", 4, 5)]


def search(lines, gene="geneX", k=3, threshold=1, ends=None):
    calls = {f"r{i}": tuple(x.split()) for i, x in enumerate(lines)}

    def node(win):
        return "~~~".join(min(win, serial_paths._flip(win)))

    walks = {r: tuple(node(c[i : i + k]) for i in range(len(c) - k + 1)) for r, c in calls.items()}
    with_gene = {n for w in walks.values() for n in w if any(g[1:] == gene for g in n.split("~~~"))}
    if ends is None:
        ends = {w[i] for w in walks.values() for i in range(len(w)) if w[i] in with_gene and (i == 0 or i == len(w) - 1 or w[i - 1] not in with_gene or w[i + 1] not in with_gene)}
    return serial_paths.full_paths(walks, calls, k, gene, ends, threshold)


def test_full_paths():
    line = "+a +b +c +geneX +d +e +f"
    found = search([line] * 3 + [" ".join(serial_paths._flip(tuple(line.split())))])
    assert list(found.values()) == [4]
    two = search(["+a +b +geneX +c +d"] * 2 + ["+p +q +geneX +s +t"] * 2)
    assert sorted(two.values()) == [2, 2]


def test_contexts_cluster_by_the_only_head():
    c = serial_paths.cluster_contexts({(), ("a",), ("b", "a"), ("c", "a")}, True)
    assert sorted(c) == [("b", "a"), ("c", "a")]
    assert serial_paths.cluster_contexts({(), ("a",), ("b", "a")}, True) == [()]


def test_a_read_that_lost_its_middle_is_repaired(spark):
    good = "+a +b +c +d +e +f +g"
    g = graph.build_graph(reads(spark, good, good, good, "+a +b +c +x +e +f +g", positions=[(10 * i, 10 * i + 9) for i in range(7)]), 3)
    out = {r["read_id"]: r for r in correct_reads(filters.filter_graph(g, 2, 1)).collect()}
    assert out["read4"]["calls"] == good.split() and len(out["read4"]["positions"]) == 7
    assert out["read1"]["calls"] == good.split()


def test_repair_trims_lost_ends():
    walk = [(None, None), ("+b~~~+c~~~+d", 1), ("+c~~~+d~~~+e", 1)]
    assert repair(["+a", "+b", "+c", "+d", "+e"], None, walk, {}, {}, 3) == (["+b", "+c", "+d", "+e"], None)
    assert repair(["+a", "+b", "+c"], [], [(None, None)], {}, {}, 3) == ([], [])


def test_bubbles():
    strong, weak = [("s", 1), ("a", 1), ("t", 1)], [("s", 1), ("b", 1), ("t", 1)]
    sets = {"s": {1, 2, 3, 4}, "t": {5, 6, 7, 8}, "a": {9}, "b": {10}}
    assert serial_bubbles.bubble_operations([[(weak, 1.0), (strong, 5.0)]], sets, 0.8) == [(strong, weak, ["b"])]
    assert serial_bubbles.bubble_operations([[(weak, 1.0), (strong, 5.0)]], {**sets, "a": set(range(30, 40)), "b": set(range(20, 30))}, 0.8) == []
    calls, places = popped("+a +b +x +d +e".split(), [(i, i) for i in range(5)], "+a +b +c +d +e".split(), "+a +b +x +d +e".split(), 3, 4)
    assert calls == "+a +b +c +d +e".split() and len(places) == 5


def test_containment_graph(spark):
    a = "ACGTTGCATGTCGCATGATGCATGAGAGCTACGTTGACCATGCA"
    rows = spark.createDataFrame([("1", a), ("2", a[:-1]), ("3", "TTTTGGGGCCCCAAAATTGGCCAATTGGACACACAGAGAGT")], "read_id string, sequence string")
    h = sketch.hashes(rows, 9).withColumnRenamed("read_id", "path_id")
    pairs = lambda t: {(r["a"], r["b"]) for r in sketch.containments(h, t).collect()}
    assert pairs(0.9) == {("1", "2")} and pairs(0) == {("1", "2"), ("1", "3"), ("2", "3")}
    assert len({r["cluster"] for r in sketch.clusters(h, 0.9).collect()}) == 2


def test_shared_reads_and_fringe(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d", "+a +b +c +d", "+a +b +c +z"), 3)
    n = {(r["a"], r["b"]): r["n"] for r in filters.shared_reads(g).collect()}
    assert n["+a~~~+b~~~+c", "+a~~~+b~~~+c"] == 3 and n["+a~~~+b~~~+c", "+b~~~+c~~~+d"] == 2
    assert filters.fringe_trim(g, 2).count() == 2
    blocks = spark.createDataFrame([(list("abc"),), (list("cb"),), (list("xy"),), (list("yx"),)], "block array<string>")
    assert sorted("".join(r["block"]) for r in filters.maximal_blocks(blocks).collect()) == ["abc", "xy"]


def test_junk_reads_round_to_even(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d +e +f +g", "+a +b +c +x +y +z +w"), 3)
    told = filters.junk_reads(filters.filter_graph(g, 2, 1), 0.5).collect()
    assert {(r["read_id"], r["lost"], r["kept"]) for r in told} == {("read1", 4, False), ("read2", 4, False)}


def test_relevance(spark):
    g = graph.build_graph(reads(spark, "+a +b +hot +d +e", "+p +q +r"), 3)
    assert filters.relevance_trim(g, ["hot"]).nodes.count() == 3
    assert filters.nodes_containing(g, "hot").count() == 3
    with pytest.raises(ValueError, match="strand"):
        filters.nodes_containing(g, "+hot")
    colours = {r["colour"] for r in graph.node_colours(g, ["hot"]).collect()}
    assert colours == {0, 1}


def test_node_numbers(spark):
    g = graph.build_graph(reads(spark, "+a +b +c +d +e"), 3)
    assert [r["number"] for r in graph.node_numbers(g).orderBy("number").collect()] == [0, 1, 2]
    assert g.nodes.agg(F.sum("coverage")).first()[0] == 3
