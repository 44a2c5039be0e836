"""A run from files to results, from calls and from alignments."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from strandloom.plans.from_files import Options, run_files, sampled

LINE = "+g1 -g2 +g3 -g4 +hot -g6 +g7 +g8 -g9 +g10".split()


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    bases = "".join(rng.choice("ACGT") for _ in range(100))
    reads = {f"r{i}": bases for i in range(8)}
    with gzip.open(tmp_path / "reads.fastq.gz", "wt") as f:
        f.write("".join(f"@{r}\n{s}\n+\n{'I' * len(s)}\n" for r, s in reads.items()))
    (tmp_path / "calls.json").write_text(json.dumps({r: LINE for r in reads}))
    (tmp_path / "positions.json").write_text(json.dumps({r: [[10 * i, 10 * i + 9] for i in range(10)] for r in reads}))
    hot = bases[40:50]
    (tmp_path / "refs.fa").write_text(f">hot;hot.1\n{hot}\n>hot;hot.2\n{hot[:-1]}\n>cold;cold.1\nACGTACGT\n")
    (tmp_path / "phenotypes.json").write_text(json.dumps({"hot.1": "burning"}))
    (tmp_path / "core.txt").write_text("g1\ng2\nnone\n")
    (tmp_path / "alleles.sam").write_text(f"@SQ\tSN:hot.1\tLN:10\n@SQ\tSN:hot.2\tLN:9\n@SQ\tSN:cold.1\tLN:8\nhot_1\t0\thot.1\t1\t60\t10=\t*\t0\t0\t{hot}\t*\nhot_1\t256\thot.2\t1\t0\t9=1I\t*\t0\t0\t*\t*\nhot_1\t256\tcold.1\t1\t0\t8=2I\t*\t0\t0\t*\t*\n")
    genes = {c[1:]: bases[10 * i : 10 * i + 10] for i, c in enumerate(LINE)}
    (tmp_path / "consensus.fastq").write_text("".join(f"@{g}\n{s}\n+\n{'I' * 10}\n" for g, s in genes.items()))
    rows = [f"@SQ\tSN:{g}\tLN:10" for g in genes]
    rows += [f"{r}\t{0 if c[0] == '+' else 16}\t{c[1:]}\t1\t60\t{_cigar(i)}\t*\t0\t0\t*\t*" for r in reads for i, c in enumerate(LINE)]
    (tmp_path / "genes.sam").write_text("\n".join(rows) + "\n")
    return tmp_path


def _cigar(i):
    """Clips tell where on the read a gene is."""
    return "".join(f"{n}{op}" for n, op in ((10 * i, "H"), (10, "="), (90 - 10 * i, "H")) if n)


def options(folder, **more):
    paths = dict(references="refs.fa", phenotypes="phenotypes.json", core_genes="core.txt", reads="reads.fastq.gz", allele_alignments="alleles.sam")
    return Options(output=str(folder / "out"), rounds=1, **({k: str(folder / v) for k, v in (paths | {k: v for k, v in more.items() if isinstance(v, str)}).items()} | {k: v for k, v in more.items() if not isinstance(v, str)}))


@pytest.mark.parametrize("source", [{"calls": "calls.json", "positions": "positions.json"}, {"alignments": "genes.sam", "consensus": "consensus.fastq"}])
def test_run_from_files(spark, folder, source):
    got = run_files(spark, options(folder, debug=True, component_reads=True, **source)).collect()
    assert [(r["allele"], r["closest_reference"], r["determinant_name"], r["sequence_name"], r["n_reads"], r["identity"], r["comments"]) for r in got] == [("hot_1", ["hot.1"], "hot.1", "burning", 8, [100.0], "")]
    assert got[0]["copy_number"] == pytest.approx(1.0)
    out = str(folder / "out")
    assert spark.read.csv(f"{out}/results", sep="\t", header=True).first()["closest_reference"] == "hot.1"
    assert spark.read.json(f"{out}/reads_per_allele").first()["reads"] == [f"r{i}" for i in range(8)]
    assert {tuple(r["calls"]) for r in spark.read.json(f"{out}/corrected_calls").collect()} == {tuple(LINE)}
    assert spark.read.text(f"{out}/allele_reads").filter(F.col("value").startswith("@")).count() == 8
    assert spark.read.text(f"{out}/graph.3.3.1.gml").first()["value"] == "graph\t["
    assert spark.read.text(f"{out}/unitigs").count() == 1 and spark.read.text(f"{out}/component_reads").count() == 32


def test_no_gene_of_interest_gives_an_empty_table(spark, folder):
    (folder / "refs.fa").write_text(">cold;cold.1\nACGT\n")
    assert run_files(spark, options(folder, calls="calls.json", positions="positions.json")).count() == 0
    assert spark.read.text(str(folder / "out" / "results")).first()["value"].startswith("determinant_name\t")


def test_depth_from_a_sample(spark):
    reads = spark.createDataFrame([(f"r{i}", ["+a", "-b", "+a"], None) for i in range(6)], "read_id string, calls array<string>, positions array<struct<start:int,end:int>>")
    core = spark.createDataFrame([("a",), ("z",)], "name string")
    cigar = "array<struct<op:int,len:int>>"
    align = spark.createDataFrame([(0, "a", [{"op": 7, "len": 30}]), (0, "b", [{"op": 7, "len": 99}])], f"flag int, rname string, cigar {cigar}")
    lengths = spark.createDataFrame([("a", 10), ("b", 10)], "name string, length int")
    few, depth = sampled(reads, 4, core, align, lengths)
    assert few.count() == 4 and depth.first()["mean_depth"] == 8.0
    whole, depth = sampled(reads, 6, core, align, lengths)
    assert whole.count() == 6 and depth.first()["mean_depth"] == 3.0


def test_options_that_do_not_fit():
    base = dict(output="o", references="r", phenotypes="p", core_genes="c")
    for more in ({}, {"reads": "r", "assembly": "a", "calls": "c", "positions": "p"}, {"reads": "r"}, {"reads": "r", "calls": "c"}, {"reads": "r", "alignments": "s"}):
        with pytest.raises(ValueError):
            Options(**base, **more)
