"""The run from files to files: reads, calls and references in, gene calls, graph, alleles and results out.

What outside programs make is taken as files: calls as JSON or as alignments of genes to reads, and
alignments of alleles to references. All is read and written by Spark, so any store it reaches will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import results, stats
from strandloom.operators.graph import as_reads, node_colours
from strandloom.plans.components import component_numbers
from strandloom.plans.pipeline import Config, Outcome, run
from strandloom.plans.storage import stored
from strandloom.sources import blocks, readers, writers


@dataclass(frozen=True)
class Options:
    """Paths and thresholds of a run. Either ``reads`` (FASTQ) or ``assembly`` (FASTA), and either ``calls`` with ``positions`` or ``alignments`` with ``consensus``."""

    output: str
    references: str
    phenotypes: str
    core_genes: str
    reads: str | None = None
    assembly: str | None = None
    calls: str | None = None
    positions: str | None = None
    call_lines: bool = False
    alignments: str | None = None
    consensus: str | None = None
    allele_alignments: str | None = None
    node_min: int = 3
    gene_min: float = 0.2
    shortest: float = 0.5
    longest: float = 1.5
    sample_size: int = 500_000
    sample: bool = True
    seed: int = 2024
    promoters: bool = False
    identity: float = 0.9
    coverage: float = 0.9
    relative_depth: float = 0.2
    meta: bool = False
    trim: bool = True
    debug: bool = False
    component_reads: bool = False
    rounds: int = 30

    def __post_init__(self) -> None:
        if (self.reads is None) == (self.assembly is None):
            raise ValueError("give either reads or an assembly")
        if (self.calls is None) == (self.alignments is None):
            raise ValueError("give either calls or alignments")
        if self.calls is not None and self.positions is None:
            raise ValueError("calls need positions")
        if self.alignments is not None and self.consensus is None:
            raise ValueError("alignments need the consensus of the genes")


def sampled(reads: DataFrame, n: int, core: DataFrame, align: DataFrame, lengths: DataFrame, seed: int = 2024) -> tuple[DataFrame, DataFrame]:
    """(reads, mean_depth): at most n reads, and one row with the mean depth over core genes.

    If reads are left out, the depth is how often the calls of the rest name a core gene that occurs; else it is that of the
    alignments. 0 without any core gene.
    """
    if reads.count() > n:
        reads = stored(readers.sample_reads(reads, n, seed), "sample")
        return reads, core_depth(reads, core)
    depths = readers.mean_depths(align, lengths).join(core, "name", "left_semi")
    return reads, depths.agg(F.coalesce(F.avg("mean_depth"), F.lit(0.0)).alias("mean_depth"))


def core_depth(reads: DataFrame, core: DataFrame) -> DataFrame:
    """One row: how often reads call a core gene, on average over those that occur."""
    calls = reads.select(F.explode("calls").alias("call")).select(F.substring("call", 2, 1 << 30).alias("name"))
    return stats.core_gene_depth(calls.groupBy("name").agg(F.count("*").alias("n")), core)


def alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments and references of a file, in its text or its block-compressed form."""
    return blocks.read_blocks(spark, path) if path.endswith(".bam") else readers.read_sam(spark, path)


def called_reads(spark: SparkSession, options: Options, genes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reads, mean_depth): calls with their places, from JSON or from alignments."""
    core = readers.read_names(spark, options.core_genes)
    if options.calls is not None:
        reads = readers.read_calls(spark, options.calls, options.positions, options.call_lines)
        return reads, core_depth(reads, core)
    align, _ = alignments(spark, options.alignments)
    lengths = readers.read_fastq(spark, options.consensus).select(F.col("read_id").alias("name"), F.length("sequence").alias("length"))
    reads = stored(readers.calls_from_alignments(align, lengths, genes, options.shortest, options.longest, options.gene_min), "called")
    if not options.sample:
        return reads, core_depth(reads, core)
    return sampled(reads, options.sample_size, core, align, lengths, options.seed)


def path_depths(alleles: DataFrame, sequences: DataFrame) -> DataFrame:
    """(allele, relative_depth, copy_number): k-mer depth of the reads of each allele over that of all, each read having one copy of it."""
    depth, counts = stats.read_depth(sequences)
    counts = stored(counts, "kmer_counts")
    if not depth:
        depth = stats.median_depth(counts).first()["depth"] or 1.0
    reads = alleles.select(F.col("allele").alias("path_id"), "read_id", F.lit(1).alias("copies")).distinct()
    return stats.copy_numbers(sequences, reads, counts, float(depth)).select(F.col("path_id").alias("allele"), "relative_depth", "copy_number")


def allele_results(spark: SparkSession, options: Options, outcome: Outcome, sequences: DataFrame, references: DataFrame, genes: list[str], mean_depth: float) -> DataFrame:
    """A row per allele that its closest reference, depth and coverage let pass."""
    n = outcome.alleles.groupBy("allele", "gene").agg(F.count_distinct("read_id").alias("n_reads"))
    if options.allele_alignments is None:
        return spark.createDataFrame([], results.RESULT)
    align, _ = alignments(spark, options.allele_alignments)
    lengths = references.select(F.col("allele").alias("rname"), F.length("sequence").alias("length")).distinct()
    own = n.join(references.select("gene", F.col("allele").alias("rname")).distinct(), "gene").select(F.col("allele").alias("qname"), "rname")
    best = results.closest_by_allele(align.join(own, ["qname", "rname"], "left_semi"), lengths, options.coverage)
    phenotypes = spark.read.text(options.phenotypes, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("allele", "phenotype"))
    rows = results.result_rows(best.join(n.select("allele", "n_reads"), "allele"), phenotypes)
    whole = options.assembly is not None or options.meta
    depths = n.select("allele", F.lit(None).cast("double").alias("relative_depth"), F.lit(None).cast("double").alias("copy_number")) if whole else stored(path_depths(outcome.alleles, sequences), "depths")
    rows = stored(results.supplement(rows, depths), "results")
    return results.filter_results(rows, outcome.alleles, outcome.reads, genes, options.identity, options.coverage, options.relative_depth, mean_depth, options.meta)


def run_files(spark: SparkSession, options: Options) -> DataFrame:
    """The results, also written under ``options.output`` with all that leads to them; none if no gene of interest is called."""
    out = options.output.rstrip("/")
    sequences = readers.read_fastq(spark, options.reads) if options.reads is not None else readers.read_fasta(spark, options.assembly)
    sequences = stored(sequences, "sequences")
    references = stored(readers.read_alleles(spark, options.references, options.promoters), "references")
    reads, depth = called_reads(spark, options, [r["gene"] for r in references.select("gene").distinct().collect()])  # as many as the reference has
    reads = stored(as_reads(reads), "called")
    mean_depth = float(depth.first()["mean_depth"])
    writers.write_calls(reads, f"{out}/gene_calls")
    present = readers.genes_present(reads, references.select(F.col("gene").alias("name")).distinct())
    genes = sorted(r["name"] for r in present.collect())
    if not genes:
        none = spark.createDataFrame([], results.RESULT)
        writers.write_results(none, f"{out}/results")
        return none
    config = Config(genes_of_interest=genes, node_min=options.node_min, rounds=options.rounds, assembly=options.assembly is not None, meta=options.meta, trim=options.trim)
    outcome = run(reads, config, sequences)
    graph = outcome.graph
    writers.write_calls(outcome.reads, f"{out}/corrected_calls")
    parts = stored(component_numbers(graph), "components")
    colours = {"colours": node_colours(graph, genes)} if options.debug else {}
    writers.write_gml(graph, f"{out}/graph", options.node_min, 1, components=parts, **colours)
    if options.debug:
        writers.write_unitigs(graph, f"{out}/unitigs")
        writers.read_length_histogram(reads).write.csv(f"{out}/read_lengths", header=True)
    if options.component_reads:
        writers.write_fastq(writers.component_reads(graph, parts, sequences), f"{out}/component_reads", ["component"])
    writers.write_fastq(writers.allele_slices(outcome.alleles, sequences), f"{out}/allele_reads", ["allele"])
    found = stored(allele_results(spark, options, outcome, sequences, references, genes, mean_depth), "results")
    writers.write_results(found, f"{out}/results")
    closest = found.select("allele", F.get("closest_reference", F.lit(0)).alias("closest_reference"))
    writers.reads_per_allele(outcome.alleles, closest).write.json(f"{out}/reads_per_allele")
    return found
