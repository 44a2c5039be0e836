"""The whole run: from calls to alleles and their depths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import filters, stats
from strandloom.operators.correct import correct_reads, pop_bubbles
from strandloom.operators.graph import Graph, as_reads, build_graph, short_reads
from strandloom.operators.paths import assign_alleles, short_read_alleles, tips
from strandloom.plans.components import component_numbers
from strandloom.plans.storage import stored
from strandloom.plans.window_choice import largest_valid, validity_by_k


@dataclass(frozen=True)
class Config:
    genes_of_interest: list[str] = field(default_factory=list)
    node_min: int = 3
    edge_min: int = 1
    component_min: int = 5
    junk_rate: float = 0.8
    rounds: int = 30
    depth_for_larger_k: float = 20.0
    ks: tuple[int, ...] = tuple(range(3, 16, 2))
    assembly: bool = False
    meta: bool = False
    trim: bool = True

    def effective(self) -> Config:
        """Assemblies and metagenomes are not thinned out."""
        return Config(**{**self.__dict__, "node_min": 1, "component_min": 1}) if self.assembly or self.meta else self


@dataclass(frozen=True)
class Outcome:
    graph: Graph
    reads: DataFrame
    alleles: DataFrame
    mean_coverage: float


def choose_k(reads: DataFrame, config: Config, mean_coverage: float) -> int:
    """The largest k up to which all components keep enough long reads of interest; 3 at low coverage."""
    if mean_coverage < config.depth_for_larger_k:
        return config.ks[0]
    return largest_valid(validity_by_k(reads, config.ks, config.genes_of_interest), config.ks)


def clean(reads: DataFrame, k: int, config: Config, sequences: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Reads after rounds of filtering, correction, tip removal and bubble popping, until nodes stay as many.

    Also the reads that have become too short for a window on the way.
    """
    short, before = None, None
    lengths = sequences.select("read_id", F.length("sequence").alias("length")) if sequences is not None else None
    for _ in range(config.rounds):
        g = build_graph(reads, k).stored()
        short = short_reads(g) if short is None else short.unionByName(short_reads(g)).dropDuplicates(["read_id"])
        g = filters.filter_graph(g, config.node_min, config.edge_min).stored()
        reads = stored(correct_reads(g, lengths), "reads")
        g = build_graph(reads, k).stored()
        n = g.nodes.count()
        if n == before:
            break
        before = n
        g = filters.remove_nodes(g, tips(g, k, config.genes_of_interest)).stored()
        reads = stored(correct_reads(g, lengths), "reads")
        if sequences is not None:
            reads = stored(pop_bubbles(build_graph(reads, k), sequences, config.genes_of_interest), "reads")
    return reads, stored(short, "short_reads")


def run(reads: DataFrame, config: Config, sequences: DataFrame | None = None) -> Outcome:
    """reads: read_id, calls, positions; sequences: read_id, sequence."""
    config = config.effective()
    g = build_graph(as_reads(reads), config.ks[0]).stored()
    if config.genes_of_interest and config.trim:
        g = filters.relevance_trim(g, config.genes_of_interest).stored()
    mean = stats.coverage_by_k(g).filter(F.col("k") == config.ks[0]).first()
    mean_coverage = float(mean["mean_reads"]) if mean else 0.0
    reads, short = stored(correct_reads(g), "reads"), None
    k = config.ks[0]
    if not config.assembly:
        if not config.meta:
            g = filters.filter_graph(build_graph(reads, k).stored(), config.node_min, config.edge_min).stored()
            reads = stored(filters.remove_junk_reads(g, config.junk_rate)[0], "reads")
        g = build_graph(reads, k).stored()
        g = filters.strong_components(g, component_numbers(g), config.component_min).stored()
        reads = stored(correct_reads(g), "reads")
        k = choose_k(reads, config, mean_coverage)
        reads, short = clean(reads, k, config, sequences)
    g = build_graph(reads, k).stored()
    alleles = assign_alleles(g, config.genes_of_interest, mean_coverage)
    if short is not None:
        more = short_read_alleles(short, config.genes_of_interest, alleles)
        alleles = alleles.unionByName(more.withColumn("component", F.lit(None).cast("long")))
    return Outcome(g, reads, stored(alleles, "alleles"), mean_coverage)
