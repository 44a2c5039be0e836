"""The graphs of several window lengths at once: one expansion of reads, one run of components.

A read's windows of one length follow each other, so they are in one component: it is enough to link each
with the read's first, and only those that are seen again, as others link nothing. Nodes are numbered over all lengths, and the components of all graphs
come from one run of stars on those numbers, in the rounds that the deepest of them takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrays import canonical_windows, names
from strandloom.operators.graph import as_reads
from strandloom.plans.components import label_components
from strandloom.plans.storage import looked_up, stored


def windows_by_k(reads: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, read_id, pos, node_id): the windows of each read for each k."""
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    each = [F.struct(F.lit(k).alias("k"), F.transform(canonical_windows(F.col("calls"), none, k), lambda w: w["node_id"]).alias("nodes")) for k in ks]
    rows = as_reads(reads).select("read_id", F.explode(F.array(*each)).alias("w"))
    return rows.select(F.col("w.k").alias("k"), "read_id", F.posexplode("w.nodes").alias("pos", "node_id"))


def read_components(reads: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, read_id, component): of each read that has a window of k calls the component of its windows, numbered over all k."""
    rows = stored(windows_by_k(reads, ks).select("read_id", "pos", F.struct("k", "node_id").alias("node")), "windows")
    nodes = rows.groupBy("node").agg(F.count("*").alias("n")).select("node", "n", F.monotonically_increasing_id().alias("number"))
    placed = stored(looked_up(rows, stored(nodes, "numbers"), "node", "n", rows.count(), keep=True).select("read_id", "pos", F.col("node.k").alias("k"), "number", "n"), "placed")
    first = placed.filter("pos = 0").select("k", "read_id", F.col("number").alias("first"))
    links = placed.filter("pos > 0 and n > 1").join(first, ["k", "read_id"]).select(F.col("first").alias("a"), F.col("number").alias("b"))
    labels = label_components(first.select(F.col("first").alias("node_id")).distinct(), links)
    starts = first.groupBy("first").agg(F.count("*").alias("n"))
    told = stored(labels.join(starts, F.col("node_id") == F.col("first")).select("first", "n", F.col("label").alias("component")), "labels")
    return looked_up(first, told, "first", "n", first.count()).select("k", "read_id", "component")


def validity_by_k(reads: DataFrame, ks: Sequence[int], genes: list[str], share: float = 0.8) -> DataFrame:
    """(k, component, valid): whether enough of a component's reads with a gene of interest have 2k - 1 calls; true without such reads."""
    reads = stored(reads, "reads")
    wanted = F.array(*map(F.lit, genes)).cast("array<string>")
    hot = reads.select("read_id", F.arrays_overlap(names(F.col("calls")), wanted).alias("hot"), F.size("calls").alias("n"))
    rows = read_components(reads, ks).join(hot, "read_id")
    long_enough = F.when(F.col("hot"), (F.col("n") >= 2 * F.col("k") - 1).cast("double"))
    told = rows.groupBy("k", "component").agg(F.avg(long_enough).alias("share"))
    return told.select("k", "component", (F.coalesce("share", F.lit(1.0)) >= share).alias("valid"))


def largest_valid(validity: DataFrame, ks: Sequence[int]) -> int:
    """The last k in order before the first that has an invalid component; the first k at least."""
    bad = {r["k"] for r in validity.filter("not valid").select("k").distinct().collect()}  # as many rows as there are k
    best = ks[0]
    for k in ks:
        if k in bad:
            break
        best = k
    return best
