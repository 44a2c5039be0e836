"""Writers of reads, graphs and results, by Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.tokens import label
from strandloom.operators.graph import Graph, node_numbers
from strandloom.operators.paths import unitigs

MARGIN = 250


def write_fastq(reads: DataFrame, path: str, parts: list[str] | None = None) -> None:
    """Gzipped FASTQ of read_id, sequence, quality; ``parts`` are columns to lay out folders by."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "sequence", F.lit("+"), "quality").alias("value")
    out = reads.filter(F.length("sequence") > 0).select(*(parts or []), record).write.option("compression", "gzip")
    (out.partitionBy(*parts) if parts else out).text(path)


def write_fasta(rows: DataFrame, path: str) -> None:
    """FASTA of read_id and sequence."""
    rows.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "sequence").alias("value")).write.text(path)


def write_calls(reads: DataFrame, path: str) -> None:
    """A line of JSON for each read: read_id, calls, positions."""
    reads.select("read_id", "calls", "positions").write.json(path)


def allele_slices(alleles: DataFrame, reads: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(allele, read_id, sequence, quality): each read around its place, the last base included; one slice per read."""
    last = alleles.groupBy("allele", "read_id").agg(F.max_by(F.struct("start", "end"), F.struct("start", "end")).alias("p")).select("allele", "read_id", "p.*")
    start = F.greatest(F.col("start") - margin, F.lit(0))
    end = F.least(F.length("sequence") - 1, F.col("end") + margin)
    cut = lambda c: F.col(c).substr(start + 1, end - start + 1).alias(c)
    return last.join(reads, "read_id").select("allele", "read_id", cut("sequence"), cut("quality"))


def longest_reads(alleles: DataFrame, reads: DataFrame) -> DataFrame:
    """(allele, read_id, length): the longest read of each allele, the least id of equal ones."""
    rows = alleles.select("allele", "read_id").distinct().join(reads.select("read_id", F.length("sequence").alias("length")), "read_id")
    best = rows.groupBy("allele").agg(F.min(F.struct((-F.col("length")).alias("less"), "read_id")).alias("b"))
    return best.select("allele", "b.read_id", (-F.col("b.less")).alias("length"))


def component_reads(g: Graph, components: DataFrame, reads: DataFrame) -> DataFrame:
    seen = g.read_nodes.join(components, "node_id").select("component", "read_id").distinct()
    return seen.join(reads, "read_id")


def reads_per_allele(alleles: DataFrame, closest: DataFrame) -> DataFrame:
    """(allele, reads): under ``allele;closest reference`` the ids of its reads, sorted."""
    rows = alleles.join(closest, "allele").select(F.concat_ws(";", "allele", "closest_reference").alias("allele"), "read_id").distinct()
    return rows.groupBy("allele").agg(F.array_sort(F.collect_set("read_id")).alias("reads"))


def node_entry(number: Column, genes: Column, coverage: Column, reads: Column, component: Column, colour: Column) -> Column:
    """A GML node; a component or colour that is null or 0 is left out."""
    line = lambda name, value: F.when(value.isNotNull() & (value != 0), F.concat(F.lit(f"\t\t{name} "), value.cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("\tnode\t[\n\t\tid "), number.cast("string"), F.lit('\n\t\tlabel "'), label(genes), F.lit('"\n\t\tcoverage '), coverage.cast("string"), F.lit("\n"), line("component", component), F.lit('\t\treads "'), reads, F.lit('"\n'), line("color", colour), F.lit("\t]"))


def edge_entry(source: Column, target: Column, source_dir: Column, target_dir: Column, weight: Column) -> Column:
    fields = (("source", source), ("target", target), ("source_direction", source_dir), ("target_direction", target_dir), ("weight", weight))
    return F.concat(F.lit("\tedge\t[\n"), *(F.concat(F.lit(f"\t\t{n} "), v.cast("string"), F.lit("\n")) for n, v in fields), F.lit("\t]"))


def gml_lines(g: Graph, components: DataFrame | None = None, colours: DataFrame | None = None) -> DataFrame:
    """(value) with an order: the graph as GML text."""
    ids = node_numbers(g)
    seen = g.read_nodes.filter("node_id is not null").select("node_id", "read_id").repartition("node_id")  # one shuffle for both groupings
    reads = seen.distinct().groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("read_id")), ",").alias("reads"))
    rows = g.nodes.join(ids, "node_id").join(reads, "node_id", "left")
    for extra, name in ((components, "component"), (colours, "colour")):
        rows = rows.join(extra.select("node_id", name), "node_id", "left") if extra is not None else rows.withColumn(name, F.lit(None).cast("int"))
    nodes = rows.select(F.lit(1).alias("part"), F.col("number").alias("a"), F.lit(0).cast("long").alias("b"), node_entry(F.col("number"), F.col("genes"), F.col("coverage"), F.coalesce("reads", F.lit("")), F.col("component"), F.col("colour")).alias("value"))
    e = g.edges.filter("coverage > 0").join(ids.select(F.col("node_id").alias("src"), F.col("number").alias("a")), "src").join(ids.select(F.col("node_id").alias("tgt"), F.col("number").alias("b")), "tgt")
    edges = e.select(F.lit(2).alias("part"), "a", "b", edge_entry(F.col("a"), F.col("b"), F.col("src_dir"), F.col("tgt_dir"), F.col("coverage")).alias("value"))
    ends = g.nodes.sparkSession.createDataFrame([(0, 0, 0, "graph\t["), (3, 0, 0, "]")], "part int, a long, b long, value string")
    return ends.unionByName(nodes).unionByName(edges)


def write_gml(g: Graph, path: str, least_node: int, least_edge: int, **parts: DataFrame) -> str:
    """One text in order, under a folder named by k and the thresholds; returns the name."""
    name = f"{path}.{g.k}.{least_node}.{least_edge}.gml"
    gml_lines(g, **parts).orderBy("part", "a", "b").select("value").coalesce(1).write.text(name)
    return name


def write_unitigs(g: Graph, path: str) -> None:
    unitigs(g).select(F.concat_ws("\t", F.array_join("genes", ","), F.col("n_reads").cast("string")).alias("value")).write.text(path)


def read_length_histogram(reads: DataFrame) -> DataFrame:
    """(n_calls, n_reads), for a plot."""
    return reads.groupBy(F.size("calls").alias("n_calls")).agg(F.count("*").alias("n_reads"))


def write_results(results: DataFrame, path: str) -> None:
    """Tab-separated results with a header; arrays of tied values are joined by /. An empty table has the header too."""
    flat = [F.array_join(c, "/").alias(c) if t.startswith("array") else F.col(c) for c, t in results.dtypes]
    results.select(*flat).coalesce(1).write.csv(path, sep="\t", header=True)
