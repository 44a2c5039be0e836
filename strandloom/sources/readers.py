"""Readers of sequence files as tables. Files are read by Spark, so any store it reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.arrays import names
from strandloom.functions.tokens import cigar_sum, mapped_call, parse_cigar, region_length, region_start
from strandloom.operators.substrings import containing
from strandloom.plans.storage import stored

LENGTH_LOW, LENGTH_HIGH = 0.5, 1.5


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, sequence, quality. Of records with the same id the last one counts.

    Lines are numbered by the counts of the splits before their own, so that large plain files
    are read and numbered in parallel; a .gz file is one split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = splits.select("file", "split", "first", (F.sum("lines").over(Window.partitionBy("file").orderBy("first")) - F.col("lines")).alias("before"))
    numbered = lines.join(before, ["file", "split"]).withColumn("n", F.col("before") + F.col("at") - F.col("first"))
    record = F.floor(F.col("n") / 4)
    part = F.col("n") % 4
    rows = numbered.groupBy("file", record.alias("record")).agg(*(F.max(F.when(part == i, F.col("line"))).alias(c) for i, c in ((0, "head"), (1, "sequence"), (3, "quality"))))
    rows = rows.filter(F.col("head").startswith("@")).select(F.regexp_extract("head", r"^@(\S+)", 1).alias("read_id"), "sequence", "quality", F.struct("file", "record").alias("at"))
    return rows.groupBy("read_id").agg(F.max_by(F.struct("sequence", "quality"), "at").alias("r")).select("read_id", "r.*")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_id, sequence, and a quality of I for each base."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter("trim(v) <> ''")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    rows = rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("read_id"), head.alias("description"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))
    return rows.select("read_id", "description", "sequence", F.repeat(F.lit("I"), F.length("sequence")).alias("quality"))


def read_calls(spark: SparkSession, calls_path: str, positions_path: str | None = None, lines: bool = False) -> DataFrame:
    """Reads from JSON maps of read id to calls, and of read id to [start, end] pairs.

    A file is one map, read whole; ``lines``: each line is one, so that large files are split.
    """

    def entries(path: str, kind: str) -> DataFrame:
        return spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("read_id", "v"))

    reads = entries(calls_path, "array<string>").withColumnRenamed("v", "calls")
    if positions_path is None:
        return reads.withColumn("positions", F.lit(None).cast("array<struct<start:int,end:int>>"))
    places = entries(positions_path, "array<array<int>>").select("read_id", F.transform("v", lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end"))).alias("positions"))
    return reads.join(places, "read_id", "left").select("read_id", "calls", "positions")


def genes_present(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes of interest (name) that some read has."""
    seen = reads.select(F.explode(names(F.col("calls"))).alias("name")).distinct()
    return genes.join(seen, "name", "left_semi").distinct()


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments (qname, flag, rname, pos from 1, mapq, cigar, seq, tags) and references (rname, length)."""
    lines = spark.read.text(path)
    f = F.split("value", "\t")
    tag = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1)
    refs = lines.filter(F.col("value").startswith("@SQ")).select(tag("SN").alias("rname"), tag("LN").cast("long").alias("length"))
    rows = lines.filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 20))))
    at = lambda i: F.get(f, F.lit(i))
    return rows.select(at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), at(3).cast("int").alias("pos"), at(4).cast("int").alias("mapq"), parse_cigar(at(5)).alias("cigar"), at(9).alias("seq"), tags.alias("tags")), refs


def calls_from_alignments(align: DataFrame, lengths: DataFrame, genes: list[str], low: float = LENGTH_LOW, high: float = LENGTH_HIGH, relative: float = 0.2) -> DataFrame:
    """Reads from mapped alignments of genes.

    lengths: name, length of each gene's consensus. Regions whose length isn't between ``low`` and
    ``high`` of it go, except genes of interest. Then genes seen less than ``relative`` of the mean
    go, those of interest too.
    """
    call = mapped_call(F.col("rname"), F.col("flag"))
    start = region_start(F.col("cigar"))
    rows = align.filter((F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("rname") != "*"))
    rows = rows.select(F.col("qname").alias("read_id"), call.alias("call"), start.alias("start"), region_length(F.col("cigar")).alias("n"))
    rows = rows.withColumn("name", F.substring("call", 2, 1 << 30)).withColumn("end", F.col("start") + F.col("n") - 1)
    rows = length_window(rows, lengths, genes, low, high)
    rows = frequent_calls(rows, relative)
    items = F.array_sort(F.collect_list(F.struct("start", "end", "call")))
    out = rows.groupBy("read_id").agg(items.alias("items"))
    return out.select("read_id", F.col("items.call").alias("calls"), F.transform("items", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"))).alias("positions"))


def length_window(rows: DataFrame, lengths: DataFrame, genes: list[str], low: float, high: float) -> DataFrame:
    """Calls (name, n) of a length within the window of the gene's own (name, length); genes of interest are exempt."""
    told = rows.join(lengths.select("name", "length"), "name")
    fits = (F.col("n") >= F.col("length") * low) & (F.col("n") <= F.col("length") * high)
    return told.filter(fits | F.col("name").isin(genes)).drop("length")


def frequent_calls(rows: DataFrame, relative: float) -> DataFrame:
    """Calls whose name is seen at least ``relative`` times as often as the mean name."""
    counts = rows.groupBy("name").agg(F.count("*").alias("seen"))
    mean = counts.agg((F.avg("seen") * F.lit(relative)).alias("least"))
    kept = counts.crossJoin(F.broadcast(mean)).filter(F.col("seen") >= F.col("least")).select("name")  # one row, broadcast
    return rows.join(kept, "name", "left_semi")


def read_alleles(spark: SparkSession, path: str, promoters: bool = False) -> DataFrame:
    """(gene, allele, sequence) from FASTA headers ``gene;allele``.

    Promoter records stand apart, unless ``promoters``: then each goes to every gene whose name
    contains the promoter's gene.
    """
    rows = read_fasta(spark, path)
    halves = F.split("description", ";")
    ok = F.when(F.size(halves) == 2, halves).otherwise(F.raise_error(F.concat(F.lit("no gene;allele header: "), "description")).cast("array<string>"))
    rows = rows.select(F.get(ok, F.lit(0)).alias("gene"), F.get(ok, F.lit(1)).alias("allele"), "sequence")
    is_promoter = F.lower("gene").contains("promoter") | F.lower("allele").contains("promoter")
    plain = rows.filter(~is_promoter)
    if not promoters:
        return plain
    return plain.unionByName(attach_promoters(plain.select("gene").distinct(), rows.filter(is_promoter)))


def attach_promoters(genes: DataFrame, promoters: DataFrame) -> DataFrame:
    """(gene, allele, sequence): promoter records under each gene whose name contains theirs, ``_promoter`` aside."""
    p = promoters.select(F.regexp_replace("gene", "(?i)_?promoter", "").alias("part"), "allele", "sequence")
    pairs = containing(genes.select(F.col("gene").alias("text")), p).withColumnRenamed("text", "gene")
    return genes.join(pairs, "gene").join(p, "part").select("gene", "allele", "sequence")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(count, n_kmers) from lines ``count n``."""
    return spark.read.csv(path, sep=" ", schema="count long, n_kmers long").filter("count is not null")


def read_kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, n) from lines ``kmer n``; others, and counts of 0, don't count."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(parts) == 2)
    return rows.select(F.get(parts, F.lit(0)).alias("kmer"), F.get(parts, F.lit(1)).cast("long").alias("n")).filter("n <> 0")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a list with one on each line."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")


def species_files(folder: str, species: str, alleles: str | None = None, names: str | None = None, core: str | None = None, plasmids: str | None = None) -> dict[str, str]:
    """The asset files of a species; what is given goes before what the folder has."""
    base = f"{folder}/{species}"
    return {"alleles": alleles or f"{base}/AMR_alleles_unified.fa", "names": names or f"{base}/AMR_calls.json", "core": core or f"{base}/core_genes.txt", "plasmids": plasmids or f"{base}/plasmid_genes.txt"}


def mean_depths(align: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, mean_depth): aligned bases over the reference's length."""
    bases = cigar_sum(F.col("cigar"), 0, 7, 8)
    per = align.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).groupBy(F.col("rname").alias("name")).agg(F.sum(bases).alias("bases"))
    return per.join(lengths, "name").select("name", (F.col("bases") / F.col("length")).alias("mean_depth"))


def uncovered_share(align: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, uncovered): of each reference the share of bases that no alignment covers."""
    start = F.col("pos") - 1
    last = start + cigar_sum(F.col("cigar"), 0, 2, 3, 7, 8) - 1
    spans = align.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).select(F.col("rname").alias("name"), F.greatest(start, F.lit(0)).alias("start"), last.alias("end"))
    covered = depth_intervals(spans).groupBy("name").agg(F.sum(F.col("last") - F.col("first") + 1).alias("covered"))
    return lengths.join(covered, "name", "left").select("name", (1 - F.coalesce("covered", F.lit(0)) / F.col("length")).alias("uncovered"))


def poorly_mapped(align: DataFrame, lengths: DataFrame, genes: list[str], most: float = 0.2) -> DataFrame:
    """(name): genes, not of interest, of which a larger share is uncovered."""
    return uncovered_share(align, lengths).filter((F.col("uncovered") > most) & ~F.col("name").isin(genes)).select("name")


def sample_reads(reads: DataFrame, n: int, seed: int = 2024) -> DataFrame:
    """At most n reads, the same ones each time."""
    return reads.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "read_id")), "read_id").limit(n)


def depth_intervals(spans: DataFrame, covered: bool = False) -> DataFrame:
    """(name, first, last, depth): the longest runs of equal depth of spans (name, start, end), both included, where it isn't 0.

    ``covered``: the longest runs without a base of depth 0 instead, with the depth at their first base.
    A span is a step up at its start and one down behind its end. Steps are summed up by place, sorted
    in ranges and added up within each; a range goes on from the sum of those before it. All
    steps of a name sum to nothing, so the sums need no regard to names, and a reference
    with a third of all spans is spread over ranges like any other. Spans that end before they start have no base.
    """
    steps = F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("end").cast("long") + 1).alias("pos"), F.lit(-1).alias("step")))
    rows = spans.filter("start <= end").select("name", F.explode(steps).alias("s")).groupBy("name", "s.pos").agg(F.sum("s.step").alias("step")).filter("step <> 0")
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, "name", "pos").withColumn("part", F.spark_partition_id()), "steps")
    own, ranges = Window.partitionBy("part").orderBy("name", "pos"), Window.orderBy("part")  # of ranges there is a row each
    before = ranged.groupBy("part").agg(F.sum("step").alias("sum")).select("part", (F.sum("sum").over(ranges) - F.col("sum")).alias("before"))
    swept = ranged.withColumn("own", F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "part")
    swept = swept.select("name", "pos", "part", (F.col("own") + F.col("before")).alias("depth"), "step")
    if covered:
        swept = swept.filter((F.col("depth") > 0) != (F.col("depth") - F.col("step") > 0))
    begin = swept.groupBy("part").agg(F.min(F.struct("name", "pos")).alias("begin")).select("part", F.lead("begin").over(ranges)["pos"].alias("next"))
    told = swept.withColumn("after", F.lead("pos").over(own)).join(F.broadcast(begin), "part").filter("depth > 0")
    return told.select("name", F.col("pos").alias("first"), (F.coalesce("after", "next") - 1).alias("last"), "depth")


def interval_depth(spans: DataFrame) -> DataFrame:
    """(name, pos, depth) of every covered base of spans (name, start, end), both included."""
    return depth_intervals(spans).select("name", F.explode(F.sequence("first", "last")).alias("pos"), "depth")


def pileup(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, first, last, covered): bounds of the covered part and the covered share of each reference."""
    per = depth_intervals(spans).groupBy("name").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    return per.join(lengths, "name").select("name", "first", "last", (F.col("n") / F.col("length")).alias("covered"))


def longest_covered_parts(spans: DataFrame) -> DataFrame:
    """(name, first, last): of each reference the first of its longest runs of covered bases."""
    runs = depth_intervals(spans, covered=True)
    best = runs.groupBy("name").agg(F.max(F.struct((F.col("last") - F.col("first")).alias("n"), (-F.col("first")).alias("at"))).alias("b"))
    return best.select("name", (-F.col("b.at")).alias("first"), (F.col("b.n") - F.col("b.at")).alias("last"))


def positions_filled(rows: DataFrame, part: str, order: str, last: Column) -> DataFrame:
    """Null start and end of rows filled from the rows before and after in their part: as windows, for long tables."""
    w = Window.partitionBy(part).orderBy(order)
    before = F.coalesce(F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.first("start", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), last)
    gap = F.col("start").isNull()
    return rows.withColumn("_s", F.when(gap, before).otherwise(F.col("start"))).withColumn("_e", F.when(gap, after).otherwise(F.col("end"))).drop("start", "end").withColumnRenamed("_s", "start").withColumnRenamed("_e", "end")
