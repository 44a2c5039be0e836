"""K-mers as numbers against cutting texts, letter by letter."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmers
from strandloom.operators import sketch, stats
from strandloom.plans.sequences import document_dna


def brute(sequence, k):
    turned = sequence.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]
    return [min(sequence[i : i + k], turned[len(sequence) - i - k : len(sequence) - i]) for i in range(len(sequence) - k + 1)]


def as_text(row, k):
    return row["other"] or kmers.letters(kmers.np.array([row["kmer"]]), k)[0].as_py()


@pytest.mark.parametrize("k,lot", [(1, 7), (9, 50), (15, 1 << 21), (31, 100), (33, 100)])
def test_counts_of_any_letters(spark, monkeypatch, k, lot):
    monkeypatch.setattr(kmers, "LETTERS", lot)
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, 14, 15, 40, 300)] + ["ACGTNNACGTacgtACGTACG" * 3, "é漢ACGT" * 9, "A" * 200, None]
    rows = [(i % 3, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "path int, sequence string")
    got = Counter({as_text(r, k): r["n"] for r in stats.kmer_counts(df, k).collect()})
    assert got == Counter(x for _, t in rows if t for x in brute(t, k))
    keyed = stats.keyed_kmers(df, ["path"], k).groupBy("path", "kmer", "other").agg(F.sum("n").alias("n")).collect()
    assert Counter({(r["path"], as_text(r, k)): r["n"] for r in keyed}) == Counter((p, x) for p, t in rows if t for x in brute(t, k))


def test_equal_places_leave_a_task_as_one_row(spark):
    """A frequent k-mer is one row a lot, not a row a place."""
    df = spark.createDataFrame([("A" * 1000,)] * 500, "sequence string").coalesce(1)
    assert stats.keyed_kmers(df, [], 15).count() == 1


def test_copies_of_paths_that_share_reads(spark):
    dna = spark.createDataFrame([("r1", "ACGTTGCATGTCGCATGA"), ("r2", "ACGTTGCATGTCGCATGANNC"), ("r3", "GGGGGGGGGGGGGGGGGGG")], "read_id string, sequence string")
    reads = spark.createDataFrame([("p", "r1", 1), ("p", "r2", 4), ("q", "r2", 2), ("q", "r3", 1)], "path_id string, read_id string, copies int")
    got = {r["path_id"]: tuple(r)[1:] for r in stats.copy_numbers(dna, reads, stats.kmer_counts(dna), 2.0).collect()}
    assert got == {"p": (2.0, 1.0, 0.25), "q": (2.0, 1.0, 0.5)}


def test_letters_of_documents(spark, tmp_path):
    texts = ["Abc xyz, ÀÉ z", "", None, "KK漢字q", "1234", "the END"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["read_id"]): r["sequence"] for r in document_dna(spark, str(tmp_path)).collect()}
    table = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    assert got == {i: None if t is None else "".join(c for c in t.lower() if "a" <= c <= "z").translate(table) for i, t in enumerate(texts)}


@pytest.mark.parametrize("k,scale,lot", [(3, 2, 50), (9, 1, 1 << 21), (11, 10, 40), (13, 3, 70), (31, 2, 1 << 21)])
def test_hashes_are_those_of_the_texts(spark, monkeypatch, k, scale, lot):
    monkeypatch.setattr(kmers, "LETTERS", lot)
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 2, 14, 40, 300, 301)] + ["ACGTNNACGTacgtACGTACG" * 3, "é漢ACGT" * 9, "A" * 200, None]
    df = spark.createDataFrame([(f"r{i % 7}", t) for i, t in enumerate(texts * 2)], "read_id string, sequence string")
    rows = [(r["read_id"], x) for r in df.collect() for x in brute(r["sequence"] or "", k)]
    told = spark.createDataFrame(rows, "read_id string, kmer string").select("read_id", F.xxhash64("kmer").alias("hash")).filter(F.pmod("hash", F.lit(scale)) == 0).distinct()
    got = sorted(map(tuple, sketch.hashes(df, k, scale).collect()))
    assert got == sorted(map(tuple, told.collect())) and len(got) > 20


def test_kmers_that_are_not_wanted_stay_in_their_task(spark):
    sequence = "".join(random.Random(2).choices("ACGT", k=20000))
    out = next(kmers._hashes(11, 10)(iter([kmers.pa.RecordBatch.from_arrays([kmers.pa.array(["r"]), kmers.pa.array([sequence])], ["read_id", "sequence"])])))
    assert 1500 < out.num_rows < 2500


def test_copy_numbers_of_packed_kmers(spark, monkeypatch):
    """Against the join of rows; what is shuffled are packed k-mers, not a row each."""
    rng = random.Random(4)
    base = ["".join(rng.choices("ACGT", k=rng.randint(0, 200))) for _ in range(12)] + ["ACGTNNACGTACGTACGTACGNACGTAAC" * 3, None]
    dna = spark.createDataFrame([(f"r{i}", rng.choice(base)) for i in range(60)], "read_id string, sequence string")
    reads = spark.createDataFrame([(f"p{rng.randint(0, 6)}", f"r{rng.randint(0, 70)}", rng.randint(1, 3)) for _ in range(50)], "path_id string, read_id string, copies int")
    expected = sorted(map(tuple, stats.copy_numbers(dna, reads, stats.kmer_counts(dna, 9), 2.0, 9).collect()))
    found = stats.sequence_copy_numbers(dna, reads, 2.0, 9)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) == 7
    assert "kmers#" in found._jdf.queryExecution().optimizedPlan().toString()
