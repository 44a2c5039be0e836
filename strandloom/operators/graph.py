"""The bi-directed graph of k-symbol windows as tables, and the lookups on it.

A read's windows, their canonical forms and the edges between neighbours are made within the
row of the read, so that building costs one shuffle for the nodes and one for the edges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrays import canonical_windows, flipped, names
from strandloom.functions.tokens import JOIN
from strandloom.plans.storage import numbered, stored

READS = "read_id string, calls array<string>, positions array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Graph:
    """reads(read_id, calls, positions); read_nodes(read_id, pos, node_id, dir, start, end), node_id null where
    filtered away; nodes(node_id, genes, coverage, n_reads, first_seen); edges(src, src_dir, tgt, tgt_dir,
    coverage, first_seen), each in both directions."""

    k: int
    reads: DataFrame
    read_nodes: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def stored(self) -> Graph:
        return replace(self, read_nodes=stored(self.read_nodes, "read_nodes"), nodes=stored(self.nodes, "nodes"), edges=stored(self.edges, "edges"))


def as_reads(df: DataFrame) -> DataFrame:
    """read_id, calls and positions, which are null if ``df`` has none."""
    if "positions" not in df.columns:
        df = df.withColumn("positions", F.lit(None).cast("array<struct<start:int,end:int>>"))
    return df.select("read_id", "calls", "positions")


def _odd(k: int) -> None:
    if k < 1 or k % 2 == 0:
        raise ValueError("k must be odd: an even window can equal its own other strand")


def read_walks(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, walk): the windows of each read in order; reads shorter than k have none."""
    _odd(k)
    return as_reads(reads).select("read_id", canonical_windows(F.col("calls"), F.col("positions"), k).alias("walk"))


def gene_mers(reads: DataFrame, k: int) -> DataFrame:
    """One row per window: read_id, pos, node_id, dir, start, end."""
    return read_walks(reads, k).select("read_id", F.posexplode("walk").alias("pos", "w")).select("read_id", "pos", "w.*")


def count_nodes(read_nodes: DataFrame) -> DataFrame:
    """Coverage counts occurrences; n_reads counts distinct reads.

    Occurrences are summed up per read first, so that no set of reads is gathered for a node.
    """
    per_read = read_nodes.filter("node_id is not null").groupBy("node_id", "read_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    out = per_read.groupBy("node_id").agg(F.sum("n").alias("coverage"), F.count("*").alias("n_reads"), F.min(F.struct("read_id", "pos")).alias("first_seen"))
    return out.select("node_id", F.split("node_id", JOIN).alias("genes"), "coverage", "n_reads", "first_seen")


def walk_edges(walks: DataFrame) -> DataFrame:
    """Both directions of the step from each window to the next, as rows with where they stand."""
    last = F.size("walk") - 2
    steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def both(i: Column) -> Column:
        a, b = F.get("walk", i), F.get("walk", i + 1)
        there = F.struct(i.alias("pos"), F.lit(0).alias("side"), a["node_id"].alias("src"), a["dir"].alias("src_dir"), b["node_id"].alias("tgt"), b["dir"].alias("tgt_dir"))
        back = F.struct(i.alias("pos"), F.lit(1).alias("side"), b["node_id"].alias("src"), (-b["dir"]).cast("tinyint").alias("src_dir"), a["node_id"].alias("tgt"), (-a["dir"]).cast("tinyint").alias("tgt_dir"))
        return F.array(there, back)

    rows = walks.select("read_id", F.explode(F.flatten(F.transform(steps, both))).alias("e")).select("read_id", "e.*")
    return rows.filter("src is not null and tgt is not null")


def count_edges(steps: DataFrame, identity: str = "four_columns") -> DataFrame:
    """Edges with coverage. ``collapsed`` takes (src, tgt, product of directions) as one edge, with the directions seen first."""
    seen = F.struct("read_id", "pos", "side")
    if identity == "four_columns":
        return steps.groupBy("src", "src_dir", "tgt", "tgt_dir").agg(F.count("*").alias("coverage"), F.min(seen).alias("first_seen"))
    if identity != "collapsed":
        raise ValueError("identity is four_columns or collapsed")
    turn = (F.col("src_dir") * F.col("tgt_dir")).cast("tinyint")
    out = steps.groupBy("src", "tgt", turn.alias("turn")).agg(F.count("*").alias("coverage"), F.min(seen).alias("first_seen"), F.min_by("src_dir", seen).alias("src_dir"))
    return out.select("src", "src_dir", "tgt", (F.col("src_dir") * F.col("turn")).cast("tinyint").alias("tgt_dir"), "coverage", "first_seen")


def build_graph(reads: DataFrame, k: int, identity: str = "four_columns") -> Graph:
    reads = as_reads(reads)
    walks = read_walks(reads, k)
    read_nodes = walks.select("read_id", F.posexplode("walk").alias("pos", "w")).select("read_id", "pos", "w.*")
    return Graph(k, reads, read_nodes, count_nodes(read_nodes), count_edges(walk_edges(walks), identity))


def _lead(read_id: Column) -> Column:
    """The first seven bytes of an id as a number, in the order of ids; equal for ids that begin alike."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(read_id, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def _walk_nodes(cut: DataFrame) -> DataFrame:
    """The nodes of written walks (read_id, lead, walk), as ``count_nodes`` has them.

    Only numbers are summed up by node, so nothing is sorted; ids are compared where the least beginning of an id is seen.
    """
    ids = F.col("walk.node_id")
    mark = lambda a, first: F.transform(a, lambda n: F.struct(n.alias("node_id"), F.lit(first).alias("first")))
    rows = cut.select("lead", F.explode(F.concat(mark(ids, 0), mark(F.array_distinct(ids), 1))).alias("n")).select("lead", "n.*")
    counts = rows.groupBy("node_id").agg(F.sum(1 - F.col("first")).alias("coverage"), F.sum("first").alias("n_reads"), F.min("lead").alias("lead"))
    counts = stored(counts, "counts")
    seen = cut.select("read_id", "lead", F.posexplode(ids).alias("pos", "node_id")).join(counts.select("node_id", "lead"), ["node_id", "lead"])
    first = seen.groupBy("node_id").agg(F.min(F.struct("read_id", "pos")).alias("first_seen"))
    return counts.join(first, "node_id").select("node_id", F.split("node_id", JOIN).alias("genes"), "coverage", "n_reads", "first_seen")


def cut_graph(reads: DataFrame, k: int, edges: bool = True) -> Graph:
    """``build_graph`` with its tables written: reads are made once, and nodes, edges and windows come from the file of their walks.

    Edges don't tell where they were first seen, which takes a sort of all steps. ``edges``: they are written too.
    """
    reads = as_reads(reads)
    _odd(k)
    cut = stored(reads.select("*", _lead(F.col("read_id")).alias("lead"), canonical_windows(F.col("calls"), F.col("positions"), k).alias("walk")), "walks")
    read_nodes = cut.select("read_id", F.posexplode("walk").alias("pos", "w")).select("read_id", "pos", "w.*")
    steps = count_edges(walk_edges(cut.select("read_id", "walk"))).drop("first_seen")
    return Graph(k, cut.select(*reads.columns), read_nodes, stored(_walk_nodes(cut), "nodes"), stored(steps, "edges") if edges else steps)


def short_reads(g: Graph) -> DataFrame:
    """Reads with fewer than k calls: they make no window."""
    return g.reads.filter(F.size("calls") < g.k)


def walks_of(g: Graph) -> DataFrame:
    """Each read's windows as one array again, in order, removed ones with a null node_id."""
    item = F.struct("pos", "node_id", "dir", "start", "end")
    return g.read_nodes.groupBy("read_id").agg(F.array_sort(F.collect_list(item)).alias("walk"))


def degrees(g: Graph) -> DataFrame:
    """(node_id, degree): edges out of either side; 0 for nodes without."""
    out = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return g.nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def node_names(g: Graph) -> DataFrame:
    return g.nodes.withColumn("names", names(F.col("genes")))


def neighbours(g: Graph, side: int | None = None, distinct: bool = False) -> DataFrame:
    """(node_id, neighbour) over edges of one side, 1 or -1, or of both."""
    out = g.edges if side is None else g.edges.filter(F.col("src_dir") == side)
    out = out.select(F.col("src").alias("node_id"), F.col("tgt").alias("neighbour"))
    return out.distinct() if distinct else out


def adjacent(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) that are neighbours both ways."""
    e = neighbours(g, distinct=True)
    there = e.select(F.col("node_id").alias("a"), F.col("neighbour").alias("b"))
    back = e.select(F.col("node_id").alias("b"), F.col("neighbour").alias("a"))
    return pairs.join(there, ["a", "b"], "left_semi").join(back, ["a", "b"], "left_semi")


def edges_between(g: Graph, pairs: DataFrame) -> DataFrame:
    """All edges of both directions between the nodes of each pair (a, b)."""
    there = pairs.join(g.edges, (F.col("a") == F.col("src")) & (F.col("b") == F.col("tgt")))
    back = pairs.join(g.edges, (F.col("b") == F.col("src")) & (F.col("a") == F.col("tgt")))
    return there.unionByName(back).distinct()


def direction_between(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, dir): the target's direction on the edge from a to b, negated."""
    return pairs.join(g.edges, (F.col("a") == F.col("src")) & (F.col("b") == F.col("tgt"))).select("a", "b", (-F.col("tgt_dir")).cast("tinyint").alias("dir"))


def reads_in_path(g: Graph, path: DataFrame) -> DataFrame:
    """Distinct reads over the nodes of ``path`` (node_id); nodes that aren't there add none."""
    return g.read_nodes.join(path.select("node_id").distinct(), "node_id", "left_semi").select("read_id").distinct()


def nodes_of_reads(g: Graph, reads: DataFrame) -> DataFrame:
    """Windows of some reads that still have a node: where it was filtered away, node_id is null, so nodes need not be counted."""
    return g.read_nodes.filter("node_id is not null").join(reads.select("read_id").distinct(), "read_id", "left_semi")


def get_node(g: Graph, genes: list[str]) -> DataFrame:
    """The node of a window as it stands in a read; an error if there is none."""
    one = g.reads.sparkSession.createDataFrame([(list(genes),)], "win array<string>").select(F.least("win", flipped(F.col("win"))).alias("genes"))
    found = one.select(F.array_join("genes", JOIN).alias("node_id")).join(g.nodes, "node_id", "left")
    return found.filter(F.when(F.col("coverage").isNotNull(), True).otherwise(F.raise_error(F.lit("no such node")).cast("boolean")))


def node_numbers(g: Graph) -> DataFrame:
    """(node_id, number): from 0 in order of first sight."""
    return numbered(g.nodes.select("node_id", "first_seen"), "number", "first_seen", "node_id").select("node_id", "number")


def node_colours(g: Graph, genes_of_interest: list[str]) -> DataFrame:
    """0 without a gene of interest; with one, 1 up to degree 2 and 2 above."""
    wanted = F.array(*map(F.lit, genes_of_interest)).cast("array<string>")
    rows = node_names(g).select("node_id", "names").join(degrees(g), "node_id")
    return rows.select("node_id", F.when(~F.arrays_overlap("names", wanted), 0).when(F.col("degree") <= 2, 1).otherwise(2).alias("colour"))


def coverage_stats(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count("*").alias("n_nodes"), F.avg("coverage").alias("mean_coverage"), F.sum("coverage").alias("total_coverage"))


def graph_totals(g: Graph) -> DataFrame:
    """n_nodes, n_edges (directed), n_reads."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(g.nodes, "n_nodes").crossJoin(n(g.edges, "n_edges")).crossJoin(n(g.reads, "n_reads"))


def merge_graphs(graphs: list[Graph]) -> Graph:
    """Union of graphs of one k: coverages add up; of a read that several have, the last one stays.

    n_reads counts a read once, however many graphs have it.
    """
    if len({g.k for g in graphs}) != 1:
        raise ValueError("graphs of one k merge")

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0].withColumn("_at", F.lit(0))
        for i, f in enumerate(frames[1:], 1):
            out = out.unionByName(f.withColumn("_at", F.lit(i)))
        return out

    last = union([g.reads for g in graphs])
    winners = last.groupBy("read_id").agg(F.max_by(F.struct("calls", "positions"), "_at").alias("r"), F.max("_at").alias("_at"))
    reads = winners.select("read_id", "r.*")
    seen = union([g.read_nodes for g in graphs])
    n_reads = seen.filter("node_id is not null").select("node_id", "read_id").distinct().groupBy("node_id").agg(F.count("*").alias("n_reads"))
    nodes = union([g.nodes for g in graphs]).groupBy("node_id").agg(F.first("genes").alias("genes"), F.sum("coverage").alias("coverage"), F.min("first_seen").alias("first_seen"))
    nodes = nodes.join(n_reads, "node_id", "left").select("node_id", "genes", "coverage", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), "first_seen")
    edges = union([g.edges for g in graphs]).groupBy("src", "src_dir", "tgt", "tgt_dir").agg(F.sum("coverage").alias("coverage"), F.min("first_seen").alias("first_seen"))
    read_nodes = seen.join(winners.select("read_id", "_at"), ["read_id", "_at"], "left_semi").drop("_at")
    return Graph(graphs[0].k, reads, read_nodes, nodes, edges)
