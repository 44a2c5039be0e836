import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph, results, stats
from strandloom.plans import pipeline
from strandloom.sources import readers, writers
from strandloom.streaming import windows


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fastq(spark, tmp_path):
    path = tmp_path / "x.fastq.gz"
    with gzip.open(path, "wt") as f:
        f.write("@r1 a\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n@r1\nTT\n+\nII\n")
    got = {r["read_id"]: (r["sequence"], r["quality"]) for r in readers.read_fastq(spark, str(path)).collect()}
    assert got == {"r1": ("TT", "II"), "r2": ("GG", "@@")}
    out = str(tmp_path / "out")
    writers.write_fastq(readers.read_fastq(spark, str(path)), out)
    assert readers.read_fastq(spark, out).count() == 2


def test_fasta_and_alleles(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">geneA;a1\nACG\nT\n>geneA_promoter;p1\nGG\n>geneAB;b1\nTT\n")
    rows = {r["read_id"]: (r["sequence"], r["quality"]) for r in readers.read_fasta(spark, path).collect()}
    assert rows["geneA;a1"] == ("ACGT", "IIII") and len(rows) == 3
    plain = {tuple(r) for r in readers.read_alleles(spark, path).collect()}
    assert plain == {("geneA", "a1", "ACGT"), ("geneAB", "b1", "TT")}
    more = {tuple(r) for r in readers.read_alleles(spark, path, True).collect()}
    assert more - plain == {("geneA", "p1", "GG"), ("geneAB", "p1", "GG")}
    with pytest.raises(Exception, match="header"):
        readers.read_alleles(spark, put(tmp_path / "b.fa", ">x\nA\n")).collect()


def test_json_calls(spark, tmp_path):
    calls = put(tmp_path / "c.json", '{"r1": ["+a", "-b"], "r2": ["+c"]}')
    places = put(tmp_path / "p.json", '{"r1": [[0, 5], [6, 9]], "r2": [[1, 2]]}')
    rows = {r["read_id"]: r for r in readers.read_calls(spark, calls, places).collect()}
    assert rows["r1"]["calls"] == ["+a", "-b"] and rows["r1"]["positions"][1]["end"] == 9
    genes = spark.createDataFrame([("a",), ("z",)], "name string")
    assert [r["name"] for r in readers.genes_present(readers.read_calls(spark, calls), genes).collect()] == ["a"]


SAM = [
    "@HD\tVN:1.6",
    *(f"@SQ\tSN:gene.{n}\tLN:{length}" for n, length in ((1, 100), (2, 100), (3, 120), (4, 200), (5, 100))),
    "q\t0\tgene.1\t1\t60\t100=\t*\t0\t0\tA\t*\tNM:i:0",
    "q\t256\tgene.2\t1\t0\t99=1X\t*\t0\t0\tA\t*\tNM:i:1",
    "q\t256\tgene.3\t1\t0\t100=\t*\t0\t0\tA\t*\tNM:i:0",
    "q\t256\tgene.4\t1\t0\t100=\t*\t0\t0\tA\t*\tNM:i:0",
    "q\t256\tgene.2\t1\t0\t50=50S\t*\t0\t0\tA\t*\tNM:i:0",
    "q\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*",
]


def test_closest_alleles_of_alignments(spark, tmp_path):
    align, refs = readers.read_sam(spark, put(tmp_path / "a.sam", "\n".join(SAM) + "\n"))
    assert align.count() == 6 and refs.count() == 5
    best = {r["rname"]: (r["match"], round(r["coverage"], 3), r["valid"], r["rank"]) for r in results.closest_alleles(align, refs, 0.9).collect()}
    assert best == {"gene.1": (1.0, 1.0, True, 1), "gene.2": (0.99, 1.0, True, 2), "gene.3": (1.0, 0.833, False, 1), "gene.4": (1.0, 0.5, False, 2)}
    of_reads = {r["rname"]: r["match"] for r in results.closest_alleles(align, refs, 0.9, "reads").collect()}
    assert of_reads == {"gene.1": 1.0, "gene.2": 0.99, "gene.3": 100 / 120, "gene.4": 0.5}


def brute_kmers(sequence, k):
    turned = sequence.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    n = len(sequence)
    return [(i, min(sequence[i : i + k], turned[n - i - k : n - i])) for i in range(n - k + 1)]


@pytest.mark.parametrize("k", [1, 5, 15, 300])
def test_kmers_of_short_and_long_sequences(spark, k):
    rng = random.Random(k)
    rows = [(str(n), "".join(rng.choices("ACGT", k=n))) for n in (0, 1, 4, 14, 15, 255, 256, 257, 270, 271, 512, 1000, 3001)] + [("none", None)]
    got = stats.kmers(spark.createDataFrame(rows, "read_id string, sequence string"), k).collect()
    assert sorted((r["read_id"], r["pos"], r["kmer"]) for r in got) == sorted((i, *x) for i, s in rows if s for x in brute_kmers(s, k))
    plain = stats.kmers(spark.createDataFrame([("a", "ACGTT")], "read_id string, sequence string"), 3, canonical=False).collect()
    assert [r["kmer"] for r in plain] == ["ACG", "CGT", "GTT"]


def test_calls_from_alignments(spark):
    rows = [("r1", 0, "g1", 1, "10M"), ("r1", 16, "g2", 1, "11H10M"), ("r1", 0, "g1", 1, "40H3M"), ("r2", 4, "*", 0, "*")]
    align = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, c string").withColumn("cigar", readers.parse_cigar(F.col("c")))
    lengths = spark.createDataFrame([("g1", 10), ("g2", 10)], "name string, length int")
    got = readers.calls_from_alignments(align, lengths, []).collect()
    assert [(r["read_id"], r["calls"]) for r in got] == [("r1", ["+g1", "-g2"])]
    assert got[0]["positions"][1]["start"] == 10 and got[0]["positions"][1]["end"] == 19


def test_depths(spark):
    rows = [(0, "g", 1, "10M"), (0, "g", 6, "10M"), (0, "h", 1, "2M")]
    align = spark.createDataFrame(rows, "flag int, rname string, pos int, c string").withColumn("cigar", readers.parse_cigar(F.col("c")))
    lengths = spark.createDataFrame([("g", 20), ("h", 20), ("n", 5)], "name string, length int")
    assert {r["name"]: round(r["uncovered"], 3) for r in readers.uncovered_share(align, lengths).collect()} == {"g": 0.25, "h": 0.9, "n": 1.0}
    assert {r["name"] for r in readers.poorly_mapped(align, lengths, ["h"], 0.2).collect()} == {"g", "n"}
    assert {r["name"]: r["mean_depth"] for r in readers.mean_depths(align, lengths).collect()} == {"g": 1.0, "h": 0.1}


def test_changes_by_cigar(spark):
    rows = spark.createDataFrame([("p", "3=1X2=2I3=2D2=", 0, "ACGTACGTAGGTT", "ACGAACTTGTATT")], "id string, c string, pos int, reference string, query string")
    got = results.cigar_changes(rows.withColumn("cigar", readers.parse_cigar(F.col("c")))).first()["changes"]
    assert got == ["T4A", "6ITT", "10-11D"]


def test_result_filter(spark):
    rows = spark.createDataFrame([("a_1", "99.5/98", "95", 1.0), ("a_2", "80", "95", 1.0), ("a_3", "99", "85.0", 0.1), ("a_4", "99", "89", 0.5)], "allele string, identity string, coverage string, relative_depth double")
    alleles = spark.createDataFrame([("a_1", "r1"), ("a_4", "r2"), ("a_3", "r2")], "allele string, read_id string")
    reads = spark.createDataFrame([("r1", ["+a"]), ("r2", ["+a", "-x"])], "read_id string, calls array<string>")
    deep = results.filter_results(rows, alleles, reads, ["a"], 0.9, 0.85, 0.2, 30.0)
    assert {(r["allele"], r["comments"]) for r in deep.collect()} == {("a_1", "Potential contaminant."), ("a_4", "Partially present gene.")}
    assert results.filter_results(rows, alleles, reads, ["a"], 0.9, 0.85, 0.2, 10.0).count() == 3


def test_supplement_misses_nothing(spark):
    rows = spark.createDataFrame([("a",)], "allele string")
    depths = spark.createDataFrame([("a", 1.0, 2.0)], "allele string, relative_depth double, copy_number double")
    assert results.supplement(rows, depths).first()["copy_number"] == 2.0
    with pytest.raises(Exception, match="no depth"):
        results.supplement(spark.createDataFrame([("b",)], "allele string"), depths).collect()


def test_statistics(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.r_[rng.poisson(1, 4000), rng.poisson(30, 6000)]
    x = x[x > 0]
    pairs = [(int(v), int((x == v).sum())) for v in np.unique(x)]
    assert 4 <= stats.mixture_cutoff(pairs) <= 14
    assert 24 <= stats.peak_depth([p for p in pairs if p[0] > 8]) <= 36
    assert stats.mixture_cutoff([]) == 0 and stats.peaks([0, 1, 1, 0, 2, 0]) == [1, 4]
    y = np.arange(40.0) ** 2
    assert np.allclose(stats.smoothed(y, 9, 3), y)


def test_copy_numbers(spark):
    s = spark.createDataFrame([("r1", "ACGTTGCATGTCGCATG" * 2), ("r2", "ACGTTGCATGTCGCATG" * 2)], "read_id string, sequence string")
    counts = stats.kmer_counts(s)
    row = stats.copy_numbers(s, spark.createDataFrame([("p", "r1", 2)], "path_id string, read_id string, copies int"), counts, 2.0).first()
    assert row["copy_number"] == row["path_depth"] / 4


def test_sinks(spark, tmp_path):
    reads = spark.createDataFrame([("r1", ["+a", "+b", "+c", "+d"], None)], graph.READS)
    g = graph.build_graph(reads, 3)
    name = writers.write_gml(g, str(tmp_path / "g"), 1, 1)
    text = "\n".join(r["value"] for r in spark.read.text(name, wholetext=True).collect())
    assert name.endswith(".3.1.1.gml") and text.count("node\t[") == 2 and text.count("edge\t[") == 2 and text.startswith("graph")
    writers.write_unitigs(g, str(tmp_path / "u"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "u")).collect()] == ["+a,+b,+c,+d\t1"]
    empty = spark.createDataFrame([], results.RESULT)
    writers.write_results(empty, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()["value"].startswith("determinant_name\t")
    alleles = spark.createDataFrame([("x", "r1", 2, 5)], "allele string, read_id string, start int, end int")
    seqs = spark.createDataFrame([("r1", "ACGTACGT", "IIIIIIII")], "read_id string, sequence string, quality string")
    assert writers.allele_slices(alleles, seqs, 1).first()["sequence"] == "CGTACG"


def test_the_whole_run(spark):
    line = "+g1 -g2 +g3 -g4 +hot -g6 +g7 +g8 -g9 +g10"
    places = [(10 * i, 10 * i + 9) for i in range(10)]
    rows = [(f"r{i}", line.split(), places) for i in range(6)] + [("bad", line.replace("-g9", "+zz").split(), places)]
    out = pipeline.run(spark.createDataFrame(rows, graph.READS), pipeline.Config(genes_of_interest=["hot"], rounds=2))
    got = {(r["allele"], r["read_id"]) for r in out.alleles.collect()}
    assert got == {("hot_1", r[0]) for r in rows}


def test_node_counts_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("r1", ["+a", "+b", "+c"], None), ("r2", ["-c", "-b", "-a"], None)], graph.READS).write.parquet(str(src))
    stream = windows.node_counts(spark.readStream.schema(graph.READS).parquet(str(src)), 3)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select node_id, coverage from counts").collect()] == [("+a~~~+b~~~+c", 2)]


def test_entry_contract(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
