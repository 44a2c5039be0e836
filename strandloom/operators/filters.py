"""Filters of nodes, edges, reads and components, as predicates and semi or anti joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrays import names
from strandloom.functions.tokens import JOIN
from strandloom.operators.graph import Graph, degrees, node_names
from strandloom.operators.suffixes import find_places, suffix_index
from strandloom.plans.storage import dropped, stored

#: Reads of more nodes than this are not paired within.
LONG_READ = 2000
#: Runs of up to so many items are cut out of each block.
SHORT_BLOCK = 32


def _wanted(genes: list[str]):
    for g in genes:
        if g[:1] in "+-":
            raise ValueError("genes of interest have no strand")
    return F.array(*map(F.lit, genes)).cast("array<string>")


def keep_nodes(g: Graph, kept: DataFrame) -> Graph:
    """The graph without all nodes but ``kept`` (node_id): their edges go, and reads have nulls there."""
    ids = kept.select("node_id").distinct()
    nodes = g.nodes.join(ids, "node_id", "left_semi")
    ends = lambda c: ids.withColumnRenamed("node_id", c)
    edges = g.edges.join(ends("src"), "src", "left_semi").join(ends("tgt"), "tgt", "left_semi")
    marked = g.read_nodes.join(ids.withColumn("kept", F.lit(True)), "node_id", "left")
    gone = lambda c: F.when(F.col("kept"), F.col(c)).alias(c)
    return replace(g, nodes=nodes, edges=edges.select(*g.edges.columns), read_nodes=marked.select("read_id", "pos", gone("node_id"), gone("dir"), "start", "end"))


def remove_nodes(g: Graph, gone: DataFrame) -> Graph:
    return keep_nodes(g, g.nodes.join(gone.select("node_id").distinct(), "node_id", "left_anti"))


def remove_edges(g: Graph, gone: DataFrame) -> Graph:
    """Without the edges of ``gone`` (src, src_dir, tgt, tgt_dir); those that aren't there don't matter."""
    return replace(g, edges=g.edges.join(gone, ["src", "src_dir", "tgt", "tgt_dir"], "left_anti"))


def nodes_below(g: Graph, least: int) -> DataFrame:
    return g.nodes.filter(F.col("coverage") < least)


def edges_below(g: Graph, least: int, gone: DataFrame) -> DataFrame:
    """Edges of lower coverage, or with an end among the nodes ``gone``."""
    ids = gone.select("node_id").distinct()
    low = g.edges.filter(F.col("coverage") < least)
    return low.union(g.edges.join(ids, F.col("src") == F.col("node_id"), "left_semi")).union(g.edges.join(ids, F.col("tgt") == F.col("node_id"), "left_semi")).distinct()


def filter_graph(g: Graph, least_node: int, least_edge: int) -> Graph:
    out = keep_nodes(g, g.nodes.filter(F.col("coverage") >= least_node))
    return replace(out, edges=out.edges.filter(F.col("coverage") >= least_edge))


def nodes_containing(g: Graph, gene: str) -> DataFrame:
    _wanted([gene])
    return node_names(g).filter(F.array_contains("names", gene))


def nodes_of_interest(g: Graph, genes: list[str]) -> DataFrame:
    return node_names(g).filter(F.arrays_overlap("names", _wanted(genes)))


def nodes_with_degree(g: Graph, degree: int) -> DataFrame:
    if not isinstance(degree, int):
        raise TypeError("a degree is an int")
    return g.nodes.join(degrees(g).filter(F.col("degree") == degree), "node_id")


def relevance_trim(g: Graph, genes: list[str]) -> Graph:
    """Only nodes that share a read with a node of interest.

    Windows are cut and written once, and looked through three times; the nodes to keep are written too.
    """
    seen = stored(g.read_nodes.filter("node_id is not null").select("read_id", "node_id"), "windows")
    ids = seen.select("node_id").distinct()
    hot = ids.filter(F.arrays_overlap(names(F.split("node_id", JOIN)), _wanted(genes)))
    reads = seen.join(hot, "node_id", "left_semi").select("read_id").distinct()
    kept = stored(seen.join(reads, "read_id", "left_semi").select("node_id").distinct(), "kept")
    dropped(seen)
    return keep_nodes(g, kept)


def reads_to_correct(g: Graph) -> DataFrame:
    """Reads that have lost a node."""
    return g.read_nodes.filter("node_id is null").select("read_id").distinct()


def valid_reads(g: Graph) -> DataFrame:
    """Reads that have lost none; those too short for a window among them."""
    return g.reads.join(reads_to_correct(g), "read_id", "left_anti")


def junk_reads(g: Graph, error_rate: float) -> DataFrame:
    """Reads with windows, and ``kept``: whether at most round(n * (1 - error_rate)) of n are lost, halves to even."""
    per = g.read_nodes.groupBy("read_id").agg(F.count("*").alias("n"), F.sum(F.col("node_id").isNull().cast("long")).alias("lost"))
    return per.select("read_id", "n", "lost", (F.col("lost") <= F.bround(F.col("n") * F.lit(1 - error_rate), 0)).alias("kept"))


def remove_junk_reads(g: Graph, error_rate: float) -> tuple[DataFrame, DataFrame]:
    """Reads that stay and reads that are rejected."""
    told = junk_reads(g, error_rate)
    return g.reads.join(told.filter("kept"), "read_id", "left_semi"), g.reads.join(told.filter("not kept"), "read_id", "left_semi")


def strong_components(g: Graph, components: DataFrame, least: int) -> Graph:
    """Without components in which every node has a lower coverage."""
    best = components.join(g.nodes, "node_id").groupBy("component").agg(F.max("coverage").alias("best"))
    return keep_nodes(g, components.join(best.filter(F.col("best") >= least), "component", "left_semi"))


def shared_reads(g: Graph, least: int = 1) -> DataFrame:
    """(a, b, n): reads that two nodes have in common, if there are ``least`` at least; the diagonal is the node's own. Absent pairs share fewer.

    Nodes in fewer reads than that make no pair. Reads of up to ``LONG_READ`` such nodes are paired within the read.
    Longer ones never are: they are looked up for the pairs of the others, and pairs that only long
    reads have come from classes of nodes in the same long reads, and only where two classes share
    enough of them, so that each pair made is a result. Until the end nodes are numbers, and a pair stands for both ways.
    """
    every = stored(g.read_nodes.filter("node_id is not null").select("read_id", "node_id").distinct(), "read_nodes")
    often = every.groupBy("node_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    ids = stored(often.select("node_id", F.monotonically_increasing_id().alias("number")), "node_numbers")
    rows = stored(every.join(ids, "node_id").groupBy("read_id").agg(F.array_sort(F.collect_list("number")).alias("nodes")), "numbered_reads")
    dropped(every)
    one = rows.filter(F.size("nodes") <= LONG_READ).select("nodes", F.explode("nodes").alias("a"))
    pairs = one.select("a", F.explode(F.filter("nodes", lambda b: b >= F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    rest = rows.filter(F.size("nodes") > LONG_READ).select("read_id", F.explode("nodes").alias("node"))
    if not rest.isEmpty():
        pairs = _with_long(stored(pairs, "short_pairs"), stored(rest, "long_nodes"), least)
    half = stored(pairs.filter(F.col("n") >= least), "pairs")
    both = half.union(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    of = lambda c: ids.select(F.col("number").alias(c), F.col("node_id").alias(f"{c}_id"))
    return both.join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "n")


def _with_long(pairs: DataFrame, rest: DataFrame, least: int) -> DataFrame:
    """``pairs`` (a, b, n), a <= b, with what nodes share in the long reads of ``rest`` (read_id, node), and enough of the pairs that only these have."""
    seen = pairs.join(rest.withColumnRenamed("node", "a"), "a").join(rest.withColumnRenamed("node", "b"), ["read_id", "b"]).groupBy("a", "b").agg(F.count("*").alias("more"))
    both = pairs.join(seen, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    marks = rest.groupBy("node").agg(F.array_sort(F.collect_list("read_id")).alias("reads")).withColumn("class", F.sha2(F.array_join("reads", "\x1f"), 256))
    marks = stored(marks, "long_classes")
    of = marks.groupBy("class").agg(F.first("reads").alias("reads")).select("class", F.explode("reads").alias("read_id"))
    alike = of.withColumnRenamed("class", "x").join(of.withColumnRenamed("class", "y"), "read_id").groupBy("x", "y").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    node = lambda c, name: marks.select(F.col("class").alias(c), F.col("node").alias(name))
    only = alike.join(node("x", "a"), "x").join(node("y", "b"), "y").filter("a <= b").join(pairs, ["a", "b"], "left_anti").select("a", "b", "n")
    return both.unionByName(only)


def removal_order(shared: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(node_id, below): how many nodes each shares under ``least`` reads with, itself included, of nodes (node_id, number).

    The one that goes first is that with the most, and of equal ones that of the least number;
    shared has (a, b, n), absent pairs share none.
    """
    enough = shared.filter(F.col("n") >= least).groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("enough"))
    whole = nodes.agg(F.count("*").alias("whole"))
    rows = nodes.join(enough, "node_id", "left").crossJoin(F.broadcast(whole))  # one row, broadcast
    return rows.select("node_id", "number", (F.col("whole") - F.coalesce("enough", F.lit(0))).alias("below"))


def weakest_node(shared: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(node_id): the node that shares too few reads with the most others; the first of equal ones, none without nodes."""
    return removal_order(shared, nodes, least).agg(F.min(F.struct((-F.col("below")).alias("less"), "number", "node_id")).alias("m")).select("m.node_id").filter("node_id is not null")


def intersection_filter(shared: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(a, b, n) without the pairs of the weakest node.

    The rule goes on while some node has a row that is untouched, but taking a node away leaves a
    gap in every row, so it ends after the first.
    """
    gone = weakest_node(shared, nodes, least)
    out = shared.join(gone.withColumnRenamed("node_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("node_id", "b"), "b", "left_anti")
    return out.select("a", "b", "n")


def fringe_trim(g: Graph, least: int) -> DataFrame:
    """Nodes that share enough reads with some node, themselves included; that is with themselves."""
    return g.nodes.filter(F.col("n_reads") >= least)


def bubble_starts(g: Graph) -> DataFrame:
    """(node_id, dir): sides of nodes with more than one edge."""
    return g.edges.groupBy(F.col("src").alias("node_id"), F.col("src_dir").alias("dir")).agg(F.count("*").alias("n")).filter("n > 1")


def component_is_valid(reads: DataFrame, components: DataFrame, read_nodes: DataFrame, genes: list[str], k: int, share: float = 0.8) -> DataFrame:
    """(component, valid): whether enough of its reads with a gene of interest have 2k - 1 calls; true without such reads."""
    wanted = _wanted(genes)
    names = F.transform("calls", lambda c: F.substring(c, 2, 1 << 30))
    hot = reads.filter(F.arrays_overlap(names, wanted)).select("read_id", (F.size("calls") >= 2 * k - 1).alias("long_enough"))
    per = read_nodes.filter("node_id is not null").join(components, "node_id").select("component", "read_id").distinct().join(hot, "read_id")
    told = per.groupBy("component").agg(F.avg(F.col("long_enough").cast("double")).alias("share"))
    return components.select("component").distinct().join(told, "component", "left").select("component", (F.coalesce("share", F.lit(1.0)) >= share).alias("valid"))


def _run(run: Column) -> list[Column]:
    """128 bits of a run and its reverse alike; a null is an item of its own."""
    text = F.transform(run, lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")))
    least = F.least(text, F.reverse(text))
    return [F.xxhash64(F.lit(salt), F.size(run), least).alias(f"run{salt}") for salt in (1, 2)]


def maximal_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (block) that stand in no longer one, forward or reversed; of a block and its reverse one stays.

    Blocks of up to ``SHORT_BLOCK`` items are looked up among the runs of their lengths that longer ones have.
    Places of longer blocks in each other come from a suffix index over these.
    """
    one = stored(blocks.select(F.least("block", F.reverse("block")).alias("block")).distinct(), "blocks")
    n = F.size("block")
    one_run = lambda i, m: F.struct(*_run(F.slice("block", i + 1, m)))
    lengths = F.sequence(F.lit(1), F.least(n - 1, F.lit(SHORT_BLOCK)))
    runs = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(0), n - m), lambda i: one_run(i, m))))
    runs = one.filter(n > 1).select(F.explode(runs).alias("r")).select("r.*").distinct()
    short = one.filter(n.between(1, SHORT_BLOCK)).select("block", *_run(F.col("block"))).join(runs, ["run1", "run2"], "left_anti").select("block")
    empty = one.filter(F.col("block").isNull() | (n == 0))  # stands nowhere
    return short.union(_maximal_long(one.filter(n > SHORT_BLOCK))).union(empty)


def _maximal_long(one: DataFrame) -> DataFrame:
    if one.isEmpty():
        return one
    one = stored(one.select(F.monotonically_increasing_id().cast("string").alias("id"), "block"), "blocks")
    index = suffix_index(one.select(F.col("id").alias("read_id"), F.col("block").alias("items")))
    turned = one.filter(F.col("block") != F.reverse("block")).select(F.concat("id", F.lit("~")).alias("path_id"), F.reverse("block").alias("path"))
    found = find_places(index, one.select(F.col("id").alias("path_id"), F.col("block").alias("path")).union(turned))
    inside = found.withColumn("id", F.rtrim("path_id", F.lit("~"))).filter("id <> read_id").select("id").distinct()
    return one.join(inside, "id", "left_anti").select("block")
