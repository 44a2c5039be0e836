"""Connected components of link tables by alternating large and small stars, round after round.

Every step is a grouped minimum and a lookup of it, so no list of neighbours is ever gathered;
the minima of nodes with very many links are broadcast, a thousand at most, so that no task
gets all links of a centre. Each round is written to the shared folder and the one before it
deleted: the lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import Graph
from strandloom.plans.storage import dropped, looked_up, numbered, stored


#: Up to so many pairs a node with all of them holds no task up, and they are joined plainly: a plan's broadcasts cost the driver memory.
FEW = 100_000


def _to_least(pairs: DataFrame, total: int) -> DataFrame:
    """``pairs`` (a, b) with the least node among each a and its b."""
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), F.count("*").alias("n"))
    if total <= FEW:
        return pairs.join(least.select("a", "least"), "a")
    return looked_up(pairs, least, "a", "n", total)


def _stars(pairs: DataFrame, larger: bool, total: int) -> DataFrame:
    """Large star: larger neighbours move to the least one. Small star: smaller ones and the node itself do."""
    if larger:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = _to_least(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        joined = _to_least(down, total)
        moved = joined.select("a", F.col("least").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``pairs`` (a, b); the component is the least node of it.

    Pairs of a node with itself, repeated ones and nulls tell nothing; without pairs there are no rows.
    """
    now, state = stored(pairs.select("a", "b").filter("a <> b").distinct(), "links"), None
    while True:
        total = now.count() if state is None else state[0]
        large = stored(_stars(now, True, total), "large_stars")  # in one plan with the small star it would stand many times over
        later = stored(_stars(large, False, total), "links")
        told = tuple(later.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        dropped(now), dropped(large)
        now = later
        if told == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = told


def label_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, label): nodes (node_id), links (a, b) in any direction; the label is the component's least node."""
    found = components(links.select("a", "b")).withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("label"))


def component_numbers(g: Graph) -> DataFrame:
    """(node_id, component): from 1, in order of the first node seen of each component.

    Nodes are numbered in that order first, so a component's least number tells its place and links are pairs of numbers.
    """
    ids = stored(numbered(g.nodes.select("node_id", "first_seen"), "number", "first_seen", "node_id").select("node_id", "number"), "node_numbers")
    of = lambda c, name: ids.select(F.col("node_id").alias(c), F.col("number").alias(name))
    ends = g.edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).filter("src <> tgt").distinct()
    links = ends.join(of("src", "a"), "src").join(of("tgt", "b"), "tgt").select("a", "b")
    labels = stored(label_components(ids.select(F.col("number").alias("node_id")), links).withColumnRenamed("node_id", "number"), "labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    numbers = numbered(sizes, "at", "label").select("label", "n", (F.col("at") + 1).alias("component"))
    told = looked_up(labels, numbers, "label", "n", labels.count()).select("number", "component")
    return ids.join(told, "number").select("node_id", "component")
