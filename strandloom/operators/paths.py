"""Chains, tips, bounded paths, junction paths, anchors, full paths and alleles."""

from __future__ import annotations

from collections.abc import Iterable
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.arrays import chained_genes, either_way, find_sublist, flipped, names
from strandloom.functions.tokens import JOIN
from strandloom.operators.alleles import gene_alleles
from strandloom.operators.filters import bubble_starts, nodes_of_interest
from strandloom.operators.graph import Graph, degrees, walks_of
from strandloom.operators.meeting import alternative_walks, state
from strandloom.plans.components import component_numbers, label_components
from strandloom.plans.storage import stored

STEP = "struct<node_id:string,dir:int>"
#: Sequences of up to so many letters go along with their read.
SHORT_SEQUENCE = 4096
TIP_FACTOR, TERMINAL_SHARE, SUPPORT_SHARE = 1.5, 0.3, 20


def _sides(g: Graph) -> DataFrame:
    return g.edges.groupBy("src", "src_dir").agg(F.count("*").alias("n"))


def chain_links(g: Graph) -> DataFrame:
    """Edges between nodes of degree 1 or 2 that are the only ones at either end: where a walk has no choice."""
    thin = degrees(g).filter("degree between 1 and 2").select("node_id")
    sides = _sides(g).filter("n = 1")
    out = sides.select("src", "src_dir")
    into = sides.select(F.col("src").alias("tgt"), (-F.col("src_dir")).cast("tinyint").alias("tgt_dir"))
    e = g.edges.filter("src <> tgt").join(out, ["src", "src_dir"], "left_semi").join(into, ["tgt", "tgt_dir"], "left_semi")
    ends = lambda c: thin.withColumnRenamed("node_id", c)
    return e.join(ends("src"), "src", "left_semi").join(ends("tgt"), "tgt", "left_semi").select("src", "src_dir", "tgt", "tgt_dir")


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chain in order: from its end of least id, or from its least id if it is a ring."""
    nodes = sorted(set(pdf["node_id"]))
    after = {(r.node_id, int(r.dir)): (r.tgt, int(r.tgt_dir)) for r in pdf[pdf["tgt"].notna()].itertuples()}
    ends = [n for n in nodes if (n, 1) not in after or (n, -1) not in after]
    first = ends[0] if ends else nodes[0]
    way = 1 if (first, 1) in after or (first, -1) not in after else -1
    walk, at = [(first, way)], after.get((first, way))
    while at is not None and at[0] != first:
        walk.append(at)
        at = after.get(at)
    return pd.DataFrame({"chain": [pdf["chain"].iloc[0]], "path": [[{"node_id": n, "dir": d} for n, d in walk]]})


def chains(g: Graph) -> DataFrame:
    """(chain, path): the maximal walks without a choice over nodes of degree 0 to 2; every such node is in one."""
    links = stored(chain_links(g), "chains")
    thin = degrees(g).filter("degree <= 2").select("node_id")
    labels = label_components(thin, links.select(F.col("src").alias("a"), F.col("tgt").alias("b")))
    rows = labels.join(links, F.col("node_id") == F.col("src"), "left").select(F.col("label").alias("chain"), "node_id", F.col("src_dir").cast("int").alias("dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"))
    return rows.groupBy("chain").applyInPandas(_ordered, f"chain string, path array<{STEP}>")


def _with_genes(path: Column) -> Column:
    return F.transform(path, lambda s: F.struct(F.split(s["node_id"], JOIN).alias("genes"), s["dir"].alias("dir")))


def path_genes(path: Column, k: int) -> Column:
    """The calls along a path of array<struct<node_id, dir>>."""
    return chained_genes(_with_genes(path), k)


def turned_path(path: Column) -> Column:
    return F.transform(F.reverse(path), lambda s: F.struct(s["node_id"].alias("node_id"), (-s["dir"]).alias("dir")))


def unitigs(g: Graph) -> DataFrame:
    """(genes, n_reads): each chain with the branching nodes that its ends lead to, in its smaller way, and its reads."""
    g = g.stored()
    found = stored(chains(g), "unitigs")
    only = g.edges.join(_sides(g).filter("n = 1").select("src", "src_dir"), ["src", "src_dir"], "left_semi")
    only = only.select(F.struct("src", F.col("src_dir").cast("int").alias("dir")).alias("end"), F.struct(F.col("tgt").alias("node_id"), F.col("tgt_dir").cast("int").alias("dir")).alias("next"))
    last, first = F.get("path", F.size("path") - 1), F.get("path", F.lit(0))
    inside = lambda c: F.exists("path", lambda s: s["node_id"] == F.col(c)["node_id"])
    out = found.withColumn("end", F.struct(last["node_id"].alias("src"), last["dir"].alias("dir"))).join(only, "end", "left").withColumnRenamed("next", "after").drop("end")
    out = out.withColumn("end", F.struct(first["node_id"].alias("src"), (-first["dir"]).alias("dir"))).join(only, "end", "left").withColumnRenamed("next", "before").drop("end")
    none = F.array().cast(f"array<{STEP}>")
    before = F.when(F.col("before").isNotNull() & ~inside("before"), turned_path(F.array("before"))).otherwise(none)
    after = F.when(F.col("after").isNotNull() & ~inside("after"), F.array("after")).otherwise(none)
    out = out.select("chain", F.concat(before, "path", after).alias("path"))
    genes = path_genes(F.col("path"), g.k)
    seen = out.select("chain", F.explode("path.node_id").alias("node_id")).distinct().join(g.read_nodes.select("node_id", "read_id").distinct(), "node_id")
    per = seen.select("chain", "read_id").distinct().groupBy("chain").agg(F.count("*").alias("n_reads"))
    return out.select("chain", F.least(genes, flipped(genes)).alias("genes")).join(per, "chain").select("genes", "n_reads").distinct()


def tip_walks(g: Graph, most: int) -> DataFrame:
    """(tip, path): from each node of degree 1 on while there is one way and the next node has degree 1 or 2.

    Walks that would get longer than ``most`` nodes are left out.
    """
    thin = stored(degrees(g).filter("degree between 1 and 2"), "thin")
    only = g.edges.join(_sides(g).filter("n = 1").select("src", "src_dir"), ["src", "src_dir"], "left_semi").filter("src <> tgt")
    only = only.join(thin.select(F.col("node_id").alias("tgt")), "tgt", "left_semi").select("src", F.col("src_dir").cast("int").alias("src_dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"))
    only = stored(only, "single_steps")
    ends = thin.filter("degree = 1").select("node_id")
    now = g.edges.join(ends, F.col("src") == F.col("node_id"), "left_semi").select(F.col("src").alias("tip"), F.array(F.struct(F.col("src").alias("node_id"), F.col("src_dir").cast("int").alias("dir"))).cast(f"array<{STEP}>").alias("path"))
    out = None
    for step in range(most):
        last = F.element_at("path", -1)
        grown = now.withColumn("src", last["node_id"]).withColumn("src_dir", last["dir"]).join(only, ["src", "src_dir"], "left")
        goes = F.col("tgt").isNotNull() & ~F.exists("path", lambda s: s["node_id"] == F.col("tgt"))
        grown = stored(grown.select("tip", "path", F.when(goes, F.struct(F.col("tgt").alias("node_id"), F.col("tgt_dir").alias("dir"))).alias("next")), "tips")
        done = grown.filter("next is null").select("tip", "path")
        out = done if out is None else out.unionByName(done)
        now = grown.filter("next is not null").select("tip", F.concat("path", F.array("next")).alias("path"))
    return out


def tips(g: Graph, least: int, genes_of_interest: Iterable[str] = (), factor: float = TIP_FACTOR) -> DataFrame:
    """(node_id): nodes of walks of under ``least`` nodes from a node of degree 1.

    Walks that are well covered all along, or that are a whole component, stay, as do nodes of interest.
    """
    g = g.stored()
    found = tip_walks(g, least - 1).select("tip", F.size("path").alias("n"), F.explode("path.node_id").alias("node_id"))
    mean = g.nodes.agg(F.avg("coverage").alias("mean"))
    parts = stored(component_numbers(g), "components")
    sizes = parts.groupBy("component").agg(F.count("*").alias("whole"))
    rows = found.join(g.nodes.select("node_id", "coverage"), "node_id").crossJoin(F.broadcast(mean)).join(parts, "node_id")
    told = rows.groupBy("tip", "n", "component").agg(F.min((F.col("coverage") > F.col("mean") * factor).cast("int")).alias("strong")).join(sizes, "component")
    gone = told.filter((F.col("strong") == 0) & (F.col("n") < F.col("whole"))).select("tip")
    out = found.join(gone, "tip", "left_semi").select("node_id").distinct()
    genes = list(genes_of_interest)
    return out.join(nodes_of_interest(g, genes).select("node_id"), "node_id", "left_anti") if genes else out


def bounded_paths(edges: DataFrame, starts: DataFrame, most: int, frontier: int = 5_000_000) -> DataFrame:
    """(start, path): all simple walks of 2 to ``most`` nodes from starts (node_id, dir), one join per step.

    Nothing is dropped: more than ``frontier`` walks at one step are an error, as the graph is too dense.
    """
    e = edges.select("src", F.col("src_dir").cast("int").alias("src_dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"))
    begin = F.struct("node_id", F.col("dir").cast("int").alias("dir"))
    now = starts.select(begin.alias("start"), F.array(begin).cast(f"array<{STEP}>").alias("path"))
    out = None
    for _ in range(most - 1):
        last = F.element_at("path", -1)
        grown = now.withColumn("src", last["node_id"]).withColumn("src_dir", last["dir"]).join(e, ["src", "src_dir"])
        grown = grown.filter(~F.exists("path", lambda s: s["node_id"] == F.col("tgt")))
        now = stored(grown.select("start", F.concat("path", F.array(F.struct(F.col("tgt").alias("node_id"), F.col("tgt_dir").alias("dir")))).alias("path")), "walks")
        n = now.count()
        if n > frontier:
            raise RuntimeError(f"{n} walks at one step; filter the graph first")
        out = now if out is None else out.unionByName(now)
        if not n:
            break
    return out


def junction_paths(g: Graph, most: int) -> DataFrame:
    """(path, coverage): alternative walks between junctions, without those that contain a shorter one.

    A walk leaves a branching side and arrives at another node's branching side; there must be two
    of a pair at least. Coverage is the mean over inner nodes. See ``operators.meeting`` for how
    they are found.
    """
    numbers = stored(g.nodes.select("node_id", F.monotonically_increasing_id().alias("number")), "numbers")
    of = lambda c: numbers.select(F.col("node_id").alias(c), F.col("number").alias(f"{c}_number"))
    steps = g.edges.join(of("src"), "src").join(of("tgt"), "tgt")
    steps = stored(steps.select(state(F.col("src_number"), F.col("src_dir")).alias("a"), state(F.col("tgt_number"), F.col("tgt_dir")).alias("b")), "steps")
    starts = bubble_starts(g).withColumnRenamed("node_id", "src").join(of("src"), "src").select(state(F.col("src_number"), F.col("dir")).alias("s"))
    walks = alternative_walks(steps, starts, most)
    rows = walks.select("walk", F.posexplode("walk").alias("pos", "s")).withColumn("number", F.shiftright("s", 1)).join(numbers, "number")
    step = F.struct("pos", F.struct("node_id", F.when(F.col("s") % 2 == 0, 1).otherwise(-1).alias("dir")).alias("step"))
    named = rows.groupBy("walk").agg(F.array_sort(F.collect_list(step)).alias("steps")).select(F.col("steps.step").cast(f"array<{STEP}>").alias("path"))
    return inner_coverage(g, stored(named.select(F.least("path", turned_path(F.col("path"))).alias("path")).distinct(), "junction_paths"))


def inner_coverage(g: Graph, paths: DataFrame) -> DataFrame:
    inner = paths.select("path", F.explode(F.slice("path.node_id", F.lit(2), F.size("path") - 2)).alias("node_id"))
    per = inner.join(g.nodes.select("node_id", "coverage"), "node_id").groupBy("path").agg(F.avg("coverage").alias("coverage"))
    return paths.join(per, "path", "left").select("path", "coverage")


def path_coverage(g: Graph, paths: DataFrame) -> DataFrame:
    """(path, coverage): the mean over all nodes."""
    rows = paths.select("path", F.explode("path.node_id").alias("node_id")).join(g.nodes.select("node_id", "coverage"), "node_id")
    return rows.groupBy("path").agg(F.avg("coverage").alias("coverage"))


def by_terminals(paths: DataFrame) -> DataFrame:
    """Paths with the unordered pair of their ends, and the longest path of the pair, to order pairs by."""
    a, b = F.get("path", F.lit(0))["node_id"], F.element_at("path", -1)["node_id"]
    rows = paths.withColumn("terminals", F.array_sort(F.array(a, b)))
    most = rows.groupBy("terminals").agg(F.max(F.size("path")).alias("longest"))
    return rows.join(most, "terminals")


def gene_anchors(g: Graph, genes: list[str], both_sides: bool = False) -> DataFrame:
    """(gene, node_id): nodes with a gene at which paths through it can begin or end.

    One of: no neighbour but itself in front (``both_sides``: or behind); a read passes it next
    to a node without the gene; it stands at read ends only and has no such neighbour on one
    side; over ``TERMINAL_SHARE`` of its places are read ends. Reads after the first one of a
    single node don't count.
    """
    wanted = F.array(*map(F.lit, genes)).cast("array<string>")
    hot = stored(g.nodes.select("node_id", F.explode(F.array_intersect(names(F.col("genes")), wanted)).alias("gene")), "gene_nodes")
    e = g.edges.join(hot, F.col("src") == F.col("node_id")).select("gene", "src", "src_dir", "tgt")
    e = e.join(hot.select("gene", F.col("node_id").alias("tgt"), F.lit(1).alias("hot")), ["gene", "tgt"], "left")
    side = lambda s, cond: F.coalesce(F.sum(((F.col("src_dir") == s) & cond).cast("int")), F.lit(0))
    other, gene_too = F.col("src") != F.col("tgt"), F.col("hot").isNotNull()
    around = e.groupBy("gene", F.col("src").alias("node_id")).agg(side(1, other).alias("front"), side(-1, other).alias("back"), side(1, gene_too).alias("hot_front"), side(-1, gene_too).alias("hot_back"))

    walk = walks_of(g).withColumn("ids", F.col("walk.node_id"))
    here = walk.select("read_id", "ids", F.posexplode("ids").alias("pos", "node_id")).select("read_id", "node_id", "pos", (F.size("ids") == 1).alias("single"), F.get("ids", F.col("pos") - 1).alias("left"), F.get("ids", F.col("pos") + 1).alias("right"), (F.col("pos") == 0).alias("first"), (F.col("pos") == F.size("ids") - 1).alias("last"))
    here = here.join(hot, "node_id")
    mark = lambda c: hot.select("gene", F.col("node_id").alias(c), F.lit(1).alias(f"{c}_hot"))
    here = here.join(mark("left"), ["gene", "left"], "left").join(mark("right"), ["gene", "right"], "left")
    until = here.filter("single").groupBy("gene", "node_id").agg(F.min("read_id").alias("until"))
    here = here.join(until, ["gene", "node_id"], "left").filter("until is null or read_id <= until")
    end = F.col("single") | F.col("first") | F.col("last")
    passes = ~end & (F.col("left_hot").isNull() | F.col("right_hot").isNull())
    told = here.groupBy("gene", "node_id").agg(F.max(passes.cast("int")).alias("passes"), F.min(F.col("single").cast("int")).alias("singles"), F.min(end.cast("int")).alias("ends"), F.avg(end.cast("double")).alias("share"))
    rows = told.join(around, ["gene", "node_id"], "left").na.fill(0)
    lonely = (F.col("front") == 0) | ((F.col("back") == 0) if both_sides else F.lit(False))
    closed = ((F.col("singles") == 1) | (F.col("ends") == 1)) & ((F.col("hot_front") == 0) | (F.col("hot_back") == 0))
    return rows.filter(lonely | (F.col("passes") == 1) | closed | ((F.col("passes") == 0) & (F.col("share") > TERMINAL_SHARE))).select("gene", "node_id")


def anchors(g: Graph, gene: str, both_sides: bool = False) -> DataFrame:
    """(node_id): the anchors of one gene."""
    if gene[:1] in "+-":
        raise ValueError("a gene is named without its strand")
    return gene_anchors(g, [gene], both_sides).select("node_id")


def assign_alleles(g: Graph, genes: list[str], mean_coverage: float | None = None) -> DataFrame:
    """(component, gene, allele, read_id, start, end) of every gene of interest; see ``operators.alleles``.

    Components come from the first node of an allele's first read; alleles are numbered anew by
    gene over components.
    """
    g = g.stored()
    if mean_coverage is None:
        mean_coverage = g.nodes.agg(F.avg("coverage")).first()[0] or 0.0
    walk = walks_of(g).select("read_id", F.col("walk.node_id").alias("ids"))
    wanted = F.array(*map(F.lit, genes)).cast("array<string>")
    reads = g.reads.join(walk, "read_id").withColumn("gene", F.explode(F.array_intersect(names(F.col("calls")), wanted)))
    rows = stored(gene_alleles(reads.select("gene", "read_id", "ids", "calls", "positions"), gene_anchors(g, genes), g.k, mean_coverage / SUPPORT_SHARE), "alleles")
    first = rows.groupBy("gene", "allele").agg(F.min("read_id").alias("read_id"))
    node = g.read_nodes.filter("node_id is not null").groupBy("read_id").agg(F.min_by("node_id", "pos").alias("node_id"))
    parts = stored(component_numbers(g), "components")
    placed = first.join(node, "read_id").join(parts, "node_id").select("gene", "allele", "component")
    rows = stored(rows.join(placed, ["gene", "allele"], "left").select("component", "gene", "allele", "read_id", "start", "end"), "alleles")
    return rows.unionByName(missed_alleles(g, genes, parts, rows))


def missed_alleles(g: Graph, genes: list[str], components: DataFrame, alleles: DataFrame) -> DataFrame:
    """One allele more, with every place of the gene, for each component that has the gene but none of its alleles."""
    wanted = F.array(*map(F.lit, genes)).cast("array<string>")
    hot = g.nodes.select("node_id", F.explode(F.array_intersect(names(F.col("genes")), wanted)).alias("gene"))
    seen = hot.join(components, "node_id").join(g.read_nodes.select("node_id", "read_id"), "node_id").select("gene", "component", "read_id").distinct()
    seen = seen.join(alleles.select("gene", "component").distinct(), ["gene", "component"], "left_anti")
    before = alleles.groupBy("gene").agg(F.count_distinct("allele").alias("n"))
    number = F.dense_rank().over(Window.partitionBy("gene").orderBy("component"))  # over components, not reads
    named = seen.select("gene", "component").distinct().join(before, "gene", "left").select("gene", "component", F.concat_ws("_", "gene", (F.coalesce("n", F.lit(0)) + number).cast("string")).alias("allele"))
    places = g.reads.select("read_id", F.posexplode("calls").alias("pos", "call"), "positions")
    places = places.select("read_id", F.substring("call", 2, 1 << 30).alias("gene"), F.get("positions", F.col("pos"))["start"].alias("start"), F.get("positions", F.col("pos"))["end"].alias("end"))
    return seen.join(named, ["gene", "component"]).join(places, ["read_id", "gene"]).select("component", "gene", "allele", "read_id", "start", "end")


def subgraph_edges(g: Graph, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes of a subset: its adjacency, as rows."""
    ends = lambda c: nodes.select(F.col("node_id").alias(c)).distinct()
    return g.edges.join(ends("src"), "src", "left_semi").join(ends("tgt"), "tgt", "left_semi").select(*g.edges.columns)


def subset_anchors(g: Graph, nodes: DataFrame) -> DataFrame:
    """(node_id, anchor, junction): nodes without a neighbour of the subset on one side, and with several on one."""
    e = subgraph_edges(g, nodes).select("src", "src_dir", "tgt").distinct()
    side = lambda s: F.coalesce(F.sum((F.col("src_dir") == s).cast("int")), F.lit(0))
    n = e.groupBy(F.col("src").alias("node_id")).agg(side(1).alias("front"), side(-1).alias("back"))
    rows = nodes.select("node_id").distinct().join(n, "node_id", "left").na.fill(0)
    return rows.select("node_id", ((F.col("front") == 0) | (F.col("back") == 0)).alias("anchor"), ((F.col("front") > 1) | (F.col("back") > 1)).alias("junction"))


def paths_between(g: Graph, nodes: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(path): simple walks within a subset of nodes from one of ``ends`` to another, of up to ``most`` nodes, in their smaller way."""
    starts = ends.select("node_id").distinct().withColumn("dir", F.explode(F.array(F.lit(1), F.lit(-1))))
    walks = bounded_paths(subgraph_edges(g, nodes), starts, most)
    last = walks.withColumn("node_id", F.element_at("path", -1)["node_id"]).join(ends.select("node_id").distinct(), "node_id", "left_semi")
    return last.select(F.least("path", turned_path(F.col("path"))).alias("path")).distinct()


def path_sequences(g: Graph, paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """(path, read_id, sequence): of each read that shares nodes with a path, what lies from the first to the last of them.

    A read and a path meet by each node they share, and the pair is kept for the least of these, as the read's row has
    them all: so what is shuffled are reads and paths, not pairs. Only long sequences are looked up for the pairs.
    """
    on = paths.select("path", F.explode("path.node_id").alias("node_id")).distinct()
    at = g.read_nodes.join(on.select("node_id").distinct(), "node_id", "left_semi").groupBy("read_id", "node_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at = at.groupBy("read_id").agg(F.collect_list(F.struct("node_id", "start", "end")).alias("at"))
    hits = F.filter("at", lambda x: F.array_contains("path.node_id", x["node_id"]))
    cut = F.col("sequence").substr(F.col("start") + 1, F.col("end") - F.col("start") + 1)

    def spans(reads: DataFrame) -> DataFrame:
        met = reads.select("*", F.explode("at.node_id").alias("node_id")).join(on, "node_id").withColumn("hits", hits)
        met = met.filter(F.col("node_id") == F.array_min("hits.node_id")).withColumns({"start": F.array_min("hits.start"), "end": F.array_max("hits.end")})
        return met.filter("start is not null and end is not null")

    short, long = (sequences.filter(c) for c in (F.length("sequence") <= SHORT_SEQUENCE, F.coalesce(F.length("sequence") > SHORT_SEQUENCE, F.lit(True))))
    near = spans(at.join(short, "read_id")).select("path", "read_id", cut.alias("sequence"))
    far = spans(at.join(long.select("read_id"), "read_id")).select("path", "read_id", "start", "end").join(long, "read_id")
    return near.unionByName(far.select("path", "read_id", cut.alias("sequence")))


def anchor_suffixes(walks: DataFrame, anchor: str, hot: DataFrame, least: int = 1) -> DataFrame:
    """(suffix, n_reads): what follows an anchor in reads (read_id, items) whose next item is in ``hot``, with enough reads."""
    at = F.array_position("items", anchor).cast("int")
    rows = walks.filter(at > 0).select("read_id", F.slice("items", at, F.size("items")).alias("suffix"))
    rows = rows.withColumn("node_id", F.get("suffix", F.lit(1))).join(hot.select("node_id").distinct(), "node_id", "left_semi")
    return rows.groupBy("suffix").agg(F.count_distinct("read_id").alias("n_reads")).filter(F.col("n_reads") >= least)


def short_read_alleles(reads: DataFrame, genes: list[str], found: DataFrame) -> DataFrame:
    """Alleles ``<gene>_1`` of genes of interest on short reads that were not found otherwise."""
    rows = reads.select("read_id", F.posexplode(F.arrays_zip(names(F.col("calls")).alias("gene"), F.col("positions").alias("at"))).alias("pos", "c"))
    rows = rows.select("read_id", F.col("c.gene").alias("gene"), F.col("c.at.start").alias("start"), F.col("c.at.end").alias("end")).filter(F.col("gene").isin(genes))
    rows = rows.join(found.select("gene").distinct(), "gene", "left_anti")
    return rows.select("gene", F.concat("gene", F.lit("_1")).alias("allele"), "read_id", "start", "end")


def path_support(walks: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, n_reads): walks (read_id, items) that contain a path (path), either way; they meet by the path's first item."""
    p = paths.select("path", F.get("path", F.lit(0)).alias("item"))
    w = walks.select("read_id", "items", F.explode(F.array_distinct("items")).alias("item"))
    hit = w.join(p, "item").filter(either_way(F.col("items"), F.col("path")))
    return hit.groupBy("path").agg(F.count_distinct("read_id").alias("n_reads"))


def path_places(walks: DataFrame, paths: DataFrame) -> DataFrame:
    """(read_id, path, places): all places of each path in each walk."""
    p = paths.select("path", F.get("path", F.lit(0)).alias("item"))
    w = walks.select("read_id", "items", F.explode(F.array_distinct("items")).alias("item"))
    return w.join(p, "item").select("read_id", "path", find_sublist(F.col("items"), F.col("path")).alias("places")).filter(F.size("places") > 0)
