"""A graph whose walks are written once, components by numbers, against the plain ways."""

import random

from strandloom.operators import graph
from strandloom.plans.components import component_numbers


def reads_of(spark, seed, n=80):
    rng = random.Random(seed)
    ids = ["", "a", "ab", "same beginning 1", "same beginning 10", "same beginning 2", "é", "été"] + [str(i) for i in range(n)]
    rows = [(r, [rng.choice("+-") + f"g{rng.randint(7 * (i % 5), 7 * (i % 5) + 4)}" for _ in range(rng.choice((1, 2, 3, 5, 9)))]) for i, r in enumerate(ids)]
    return graph.as_reads(spark.createDataFrame(rows, "read_id string, calls array<string>"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_as_a_built_graph(spark):
    reads = reads_of(spark, 1)
    a, b = graph.build_graph(reads, 3), graph.cut_graph(reads, 3)
    assert rows_of(a.nodes) == rows_of(b.nodes.select(*a.nodes.columns)) and rows_of(a.read_nodes) == rows_of(b.read_nodes)
    assert rows_of(a.edges.drop("first_seen")) == rows_of(b.edges) and rows_of(a.reads) == rows_of(b.reads)


def test_reads_are_made_once(spark):
    """Before, nodes, edges and windows each made the reads and their windows anew."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    reads = reads_of(spark, 2)
    n = reads.count()
    g = graph.cut_graph(reads.mapInArrow(count, reads.schema), 3)
    g.nodes.count(), g.edges.count(), g.read_nodes.count(), component_numbers(g).count()
    assert made.value == n


def test_components_in_order_of_sight(spark):
    g = graph.cut_graph(reads_of(spark, 3), 3)
    links = {}
    for r in g.edges.collect():
        links.setdefault(r.src, set()).add(r.tgt)
    number, last = {}, 0
    for r in g.nodes.orderBy("first_seen").collect():
        if r.node_id not in number:
            last, todo = last + 1, [r.node_id]
            while todo:
                x = todo.pop()
                if x not in number:
                    number[x] = last
                    todo += links.get(x, ())
    assert last > 3 and {r.node_id: r.component for r in component_numbers(g).collect()} == number
