"""Histograms, depth, mixtures and copy numbers. Rows are grouped by Spark; only histograms reach the driver."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.kmers import LONGEST, counted_kmers, path_counts
from strandloom.functions.tokens import reverse_complement
from strandloom.operators.graph import Graph

KMER = 15
#: Bases of a sequence that are cut into k-mers together: each cut walks a short text only.
CHUNK = 256


def coverage_histogram(g: Graph, width: int = 5) -> DataFrame:
    return g.nodes.groupBy(F.floor(F.col("coverage") / width).alias("bin")).agg(F.count("*").alias("n"))


def coverage_by_k(g: Graph, ks=tuple(range(3, 16, 2))) -> DataFrame:
    """(k, mean_reads): over all nodes, the mean number of distinct reads with k calls or more."""
    sizes = g.reads.select("read_id", F.size("calls").alias("n"))
    seen = g.read_nodes.filter("node_id is not null").select("node_id", "read_id").distinct().join(sizes, "read_id")
    per = seen.groupBy("node_id").agg(*(F.sum((F.col("n") >= k).cast("long")).alias(f"k{k}") for k in ks))
    means = per.agg(*(F.coalesce(F.avg(f"k{k}"), F.lit(0.0)).alias(f"k{k}") for k in ks))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("mean_reads")) for k in ks))).alias("r")).select("r.*")


def smoothed(y, window: int, degree: int) -> np.ndarray:
    """Least-squares polynomials over a sliding window; the first and last ones also tell the borders."""
    y = np.asarray(y, float)
    n = min(window, len(y) if len(y) % 2 else len(y) - 1)
    if n <= degree:
        return y
    half = n // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], "same")
    at = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    out[:half], out[-half:] = (at @ (fit @ y[:n]))[:half], (at @ (fit @ y[-n:]))[-half:]
    return out


def peaks(y) -> list[int]:
    """Places above both neighbours; the middle of a flat top."""
    out, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i] > y[i - 1]:
            j = i
            while j + 1 < n and y[j + 1] == y[i]:
                j += 1
            if j + 1 < n and y[j + 1] < y[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def coverage_trough(histogram: list[tuple[int, int]], window: int = 31, degree: int = 5) -> int | None:
    """The bin of least smoothed log count between the first two peaks, or None; histogram: (bin, n) from Spark."""
    counts = dict(histogram)
    y = smoothed(np.log([counts.get(b, 0) + 1 for b in range(max(counts, default=0) + 1)]), window, degree)
    top = peaks(y)
    return top[0] + int(np.argmin(y[top[0] : top[1] + 1])) if len(top) > 1 else None


def _log_poisson(i: np.ndarray, mean: float) -> np.ndarray:
    return i * np.log(mean) - mean - np.array([lgamma(x + 1) for x in i])


def mixture_cutoff(histogram: list[tuple[int, int]], rounds: int = 500) -> int:
    """The first count at which a copy is likelier real than an error, by a mixture of two Poisson laws.

    Errors have mean 1; the share of errors and the mean of real counts are fitted by expectation
    and maximisation from 0.1 and 10. 0 if no count is.
    """
    pairs = sorted(histogram)
    if not pairs:
        return 0
    i, n = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    w, c = 0.1, 10.0
    for _ in range(rounds):
        error, real = np.log(max(w, 1e-12)) + _log_poisson(i, 1.0), np.log(max(1 - w, 1e-12)) + _log_poisson(i, c)
        share = 1 / (1 + np.exp(np.clip(real - error, -700, 700)))
        nw, weight = float((n * share).sum() / n.sum()), float((n * (1 - share)).sum())
        nc = float((n * (1 - share) * i).sum() / weight) if weight > 0 else c
        done = abs(nw - w) < 1e-10 and abs(nc - c) < 1e-10
        w, c = nw, max(nc, 1e-9)
        if done:
            break
    better = np.flatnonzero(np.log(max(1 - w, 1e-12)) + _log_poisson(i, c) > np.log(max(w, 1e-12)) + _log_poisson(i, 1.0))
    return int(i[better[0]]) if len(better) else 0


def peak_depth(histogram: list[tuple[int, int]]) -> int | None:
    """The count at the highest peak of the smoothed log histogram, or None."""
    pairs = sorted(histogram)
    y = np.log(np.array([n for _, n in pairs], float) + 1)
    window = min(29, len(y) // 2 * 2 - 1)
    s = smoothed(y, window, 3) if window > 3 else y
    top = peaks(s)
    return pairs[max(top, key=lambda p: s[p])][0] if top else None


def kmers(sequences: DataFrame, k: int = KMER, canonical: bool = True) -> DataFrame:
    """read_id, pos and kmer of every place; the smaller of a k-mer and its reverse complement if canonical.

    Sequences are cut into chunks first, each with the k - 1 bases behind it and its own reverse
    complement, so that the work is in proportion to the length of a sequence.
    """
    size = max(CHUNK, k)
    first = lambda parts: F.transform(
        parts,
        lambda c, i: F.struct((i * size).alias("base"), F.length(c).alias("own"), F.concat(c, F.coalesce(F.substring(F.get(parts, i + 1), 1, k - 1), F.lit(""))).alias("bases")),
    )
    parts = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = sequences.select("read_id", F.explode(F.flatten(F.transform(F.array(parts), first))).alias("c")).select("read_id", "c.*")
    rows = rows.withColumn("turned", reverse_complement(F.col("bases"))) if canonical else rows
    last = F.least(F.col("own") - 1, F.length("bases") - k)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.explode(places).alias("at"))
    kmer = F.col("bases").substr(F.col("at") + 1, F.lit(k))
    if canonical:
        kmer = F.least(kmer, F.col("turned").substr(F.length("bases") - F.col("at") - (k - 1), F.lit(k)))
    return rows.select("read_id", (F.col("base") + F.col("at")).alias("pos"), kmer.alias("kmer"))


def keyed_kmers(sequences: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(*keys, kmer, other, n): canonical k-mers of sequences (*keys, sequence), summed up in part.

    kmer is a number, and other the text where a long can't hold it: with letters but ACGT, or of over ``LONGEST`` bases.
    """
    if k <= LONGEST:
        return counted_kmers(sequences, keys, k)
    of = [F.col(f"read_id.{c}").alias(c) for c in keys]
    rows = kmers(sequences.select(F.struct(*keys, F.lit(0)).alias("read_id"), "sequence"), k)
    return rows.select(*of, F.lit(-1).cast("long").alias("kmer"), F.col("kmer").alias("other"), F.lit(1).cast("long").alias("n"))


def kmer_counts(sequences: DataFrame, k: int = KMER) -> DataFrame:
    """(kmer, other, n): see ``keyed_kmers``."""
    return keyed_kmers(sequences, [], k).repartition("kmer", "other").groupBy("kmer", "other").agg(F.sum("n").alias("n"))


def count_histogram(counts: DataFrame) -> DataFrame:
    """(count, n_kmers); distinct counts are at most the square root of twice the number of all k-mers."""
    return counts.groupBy(F.col("n").alias("count")).agg(F.count("*").alias("n_kmers"))


def read_depth(sequences: DataFrame, k: int = KMER) -> tuple[int | None, DataFrame]:
    """The depth of the whole, and the k-mer counts that are no errors."""
    counts = kmer_counts(sequences, k)
    pairs = [(r["count"], r["n_kmers"]) for r in count_histogram(counts).collect()]
    cutoff = mixture_cutoff(pairs)
    return peak_depth([p for p in pairs if p[0] >= cutoff]), counts.filter(F.col("n") >= cutoff)


def median_depth(counts: DataFrame) -> DataFrame:
    return counts.filter("n <> 0").agg(F.median("n").alias("depth"))


def copy_numbers(sequences: DataFrame, path_reads: DataFrame, counts: DataFrame, depth: float, k: int = KMER) -> DataFrame:
    """Per path its median k-mer depth, that over the whole depth, and copies per gene copy of the path.

    path_reads: path_id, read_id, copies (of the gene in the path).
    """
    own = keyed_kmers(path_reads.join(sequences, "read_id"), ["path_id", "copies"], k).repartition("kmer", "other")
    seen = own.groupBy("path_id", "kmer", "other").agg(F.max("copies").alias("copies"))
    per = seen.join(counts, ["kmer", "other"]).groupBy("path_id").agg(F.median("n").alias("path_depth"), F.max("copies").alias("copies"))
    relative: Column = F.col("path_depth") / F.lit(float(depth))
    return per.select("path_id", "path_depth", relative.alias("relative_depth"), (relative / F.col("copies")).alias("copy_number"))


def sequence_copy_numbers(sequences: DataFrame, path_reads: DataFrame, depth: float, k: int = KMER) -> DataFrame:
    """``copy_numbers`` by all k-mers of the sequences."""
    if k > LONGEST:
        return copy_numbers(sequences, path_reads, kmer_counts(sequences, k), depth, k)
    found = path_counts(sequences, path_reads.join(sequences, "read_id").select("path_id", "copies", "sequence"), k)
    per = found.groupBy("path_id").agg(F.percentile("n", F.lit(0.5), F.col("times")).alias("path_depth"), F.max("copies").alias("copies"))
    relative: Column = F.col("path_depth") / F.lit(float(depth))
    return per.select("path_id", "path_depth", relative.alias("relative_depth"), (relative / F.col("copies")).alias("copy_number"))


def cluster_copies(clusters: DataFrame, mean_coverage: float) -> DataFrame:
    """clusters: allele, n_reads. The reads over the mean coverage, 1 at least."""
    return clusters.select("allele", F.greatest(F.lit(1.0), F.col("n_reads") / F.lit(float(mean_coverage))).alias("copy_number"))


def core_gene_depth(call_counts: DataFrame, core: DataFrame) -> DataFrame:
    """call_counts: name, n; core: name. Mean occurrences of core genes that occur; 0 without any."""
    return call_counts.join(core.select("name").distinct(), "name", "left_semi").agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_depth"))
