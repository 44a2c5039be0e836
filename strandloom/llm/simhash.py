"""SimHash near-duplicates, candidate pairs pruned by tables of pivot distances.

Fingerprints are summed up over all shingles of the whole text. Equal fingerprints form one
class, so copies cost one row each and never a pair. Classes meet in buckets: the 64 bits
are cut into n blocks, and two fingerprints within r bits agree on n - r blocks at least, so
a table for each choice of n - r blocks misses no link. n grows with the number of
classes until buckets are small (see ``plan_blocks``); each n is exact.

Within a bucket the distances of every fingerprint to ``PIVOTS`` reference fingerprints are
computed once. By the triangle inequality a pair whose distances to any reference differ by
more than r can't be within r; only pairs that all references let pass are compared bit by
bit. The references are rows of the 64 x 64 Hadamard matrix: for a pair that differs in D
bits the squares of its coordinate differences over all 64 sum to 64 D, so that all pairs
with D > r * r are sure to be dropped by the full table. Buckets of dense groups emit a
spanning forest, not all pairs. Buckets over ``PART`` rows are dealt out to pairs of parts,
so that no task holds more than two parts.

Null and empty texts have fingerprint zero and are linked to each other and to near ones.
Rows with a null doc_id are kept; they take the least id of their group, null if there is
none. Repeated rows come out as often as they came in. A text of any length is read whole, a
part of its shingles at a time. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import looked_up, stored, worker_cache
from strandloom.llm.components import components

SEED, RADIUS = 42, 4
PART = 8192
BUCKET = 32
PIVOTS = 16


def pivot_fingerprints(count: int = 64) -> np.ndarray:
    """Rows of the Hadamard matrix of order 64 as 64-bit words."""
    place = np.arange(64, dtype=np.uint64)
    rows = [int(np.sum((np.bitwise_count(place & np.uint64(r)) & 1).astype(np.uint64) << place)) for r in range(64)]
    order = sorted(range(64), key=lambda r: (r * 37) % 64)  # neighbouring rows share many bits; mix them
    return np.array([rows[r] for r in order[:count]], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("simhash")
    for batch in batches:
        got = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def plan_blocks(classes: int, radius: int = RADIUS) -> int:
    """The least number of blocks, two over the radius or more, at which a bucket of evenly spread fingerprints has about ``BUCKET`` rows."""
    for n in range(radius + 2, radius + 6):
        if classes / 2 ** (64 * (n - radius) // n) <= BUCKET:
            return n
    return radius + 6


def _masks(n: int, radius: int) -> list[int]:
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    return [sum(c) for c in combinations(blocks, n - radius)]


def _near(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs a[i], b[i] are within the radius; at, bt: their rows of the pivot table."""
    keep = np.arange(len(b))
    for p in range(at.shape[-1]):  # one coordinate after another, so that few pairs see many of them
        x = at[..., p]
        keep = keep[np.abs((x if x.ndim == 0 else x[keep]) - bt[keep, p]) <= radius]
        if not len(keep):
            return keep
    x = a if np.ndim(a) == 0 else a[keep]
    return keep[np.bitwise_count(x ^ b[keep]) <= radius]


def _forest(fp: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that span each linked group of one bucket: each row looks only at rows not reached yet."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _near(fp[at], fp[left], table[at], table[left], radius)
            if len(hit):
                found = left[hit]
                yield np.full(len(found), at), found
                queue += found.tolist()
                left = np.delete(left, hit)


def _bucket_links(radius: int):
    pivots = pivot_fingerprints(PIVOTS)

    def links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: bucket numbers in order."""
        table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [], []
        small = np.repeat(sizes <= 64, sizes)
        for step in range(1, int(min(64, sizes.max(initial=0)))):
            i = np.flatnonzero((keys[:-step] == keys[step:]) & small[:-step])
            if not len(i):
                break
            hit = i[_near(fp[i], fp[i + step], table[i], table[i + step], radius)]
            a.append(hit), b.append(hit + step)
        for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            for x, y in _forest(fp[s : s + n], table[s : s + n], radius):
                a.append(x + s), b.append(y + s)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, int)
        return join(a), join(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = links(keys, fp)
            pairs = np.unique(np.stack([fp[a].view(np.int64), fp[b].view(np.int64)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys, fp = (np.asarray(c) for c in batch.columns)
            fp = fp.view(np.uint64)
            held.append((keys, fp))
            last = np.flatnonzero(keys != keys[-1])
            if not len(last):
                continue  # one bucket still; it has two parts of rows at most
            cut = last[-1] + 1
            held[-1] = (keys[:cut], fp[:cut])
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(keys[cut:], fp[cut:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def fingerprint_links(classes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that join every linked group, as a forest per bucket."""
    masks = _masks(plan_blocks(count, radius), radius)
    rows = classes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))).alias("t", "key"))
    heavy = rows.groupBy("t", "key").count().filter(F.col("count") > PART)
    rows = rows.join(heavy, ["t", "key"], "left").withColumn("parts", F.ceil(F.coalesce(F.col("count"), F.lit(1)) / PART).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(other)))
    rows = rows.select("fp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least doc_id that links reach."""
    fps = stored(fingerprints(docs, text, doc_id), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    told = classes.agg(F.count("*").alias("classes"), F.sum("n").alias("rows")).first()
    groups = components(fingerprint_links(classes, told["classes"], radius))
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named.select("fp", "n", "least", "component"), "labelled")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    # Neither the classes of a large component nor the rows of a frequent fingerprint meet in one task.
    named = stored(looked_up(named, least, "component", "classes", told["classes"]).select("fp", "n", "component_id"), "named")
    out = looked_up(fps, named, "fp", "n", told["rows"] or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
