"""Nearest neighbours by inner product, with vantage-point trees over shards of the vectors.

The inner product is no metric, so vectors x get one more component, sqrt(M * M - |x| * |x|) for
the largest norm M, and queries q a zero: |q' - x'| ** 2 = |q| ** 2 + M * M - 2 q x, so that the nearest
by distance are those with the largest product, and the triangle inequality holds.

Vectors are dealt to cells by a tree of vantage points that is fitted on at most ``SAMPLE`` distinct
vectors: at each node those within the node's radius go one way, the others the other way. Each
cell is cut by hash into shards of about ``SHARD`` vectors, so that a shard fits in a task
however many vectors a cell has. A query is searched in its own cell first, which bounds the
distance of its k-th neighbour, then in all cells that the bound does not rule out. In a shard a
tree is built over all its vectors; a query goes to its own leaf, then to each other
leaf. A cell or leaf is passed over if its least possible distance, by the triangle inequality
for all vantage points above it, times ``factor`` is over the distance of the k-th neighbour so
far. Factor one gives exact results; a larger one passes over more and may lose neighbours.

Equal vectors are one vector with a list of at most k + 1 least ids, made by a grouping that
keeps that many in each task before it shuffles: more of them can't be among the k nearest of
anything. So copies of a vector are neither stored nor compared again, and queries that are equal
are searched once. Queries go to shards in blocks of about ``BLOCK``; no task holds more than a
block and a shard, whatever the numbers. Of each block and shard come the k + 1 nearest at most.

Scores are inner products in double precision of the vectors as given. Vectors that are null,
empty, zero or hold nulls or non-finite components take no part; shorter ones are compared as if filled
up with zeros. Rows with equal vec_id and vector count once; those with equal vec_id and other
vectors are rows of their own. Rows with a null vec_id are found but ask nothing, and come
last in ties. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import looked_up, stored, worker_cache
from strandloom.llm.vector_codes import finite

SAMPLE, SHARD, BLOCK, LEAF = 8192, 16384, 4096, 256
#: Cells are as many as make about ``CELL`` vectors each, to ``CELLS`` at most; beyond that each has more shards.
CELL, CELLS = 4096, 1024
#: Bounds are computed in doubles: a place is passed over only beyond this share of the largest distance.
SLACK = 1e-6


class VantageTree:
    """A vantage-point tree over vectors ``x`` with the added component ``w``; leaves hold ``members``.

    Node i has the children 2 i + 1 (within the radius) and 2 i + 2; all leaves are at one depth.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray, depth: int) -> None:
        inner = (1 << depth) - 1
        self.depth, self.points, self.added, self.radii = depth, np.zeros((inner, x.shape[1])), np.zeros(inner), np.full(inner, -1.0)
        held = {0: np.arange(len(x))}
        for node in range(inner):
            rows = held.pop(node)
            if not len(rows):
                held[2 * node + 1], held[2 * node + 2] = rows, rows
                continue
            far = self._spread(x, w, rows)
            self.points[node], self.added[node] = x[far], w[far]
            away = np.sqrt(np.maximum(((x[rows] - x[far]) ** 2).sum(1) + (w[rows] - w[far]) ** 2, 0))
            self.radii[node] = np.partition(away, (len(away) - 1) // 2)[(len(away) - 1) // 2]
            near = away <= self.radii[node]
            held[2 * node + 1], held[2 * node + 2] = rows[near], rows[~near]
        self.members = [held[inner + i] for i in range(inner + 1)]

    @staticmethod
    def _spread(x: np.ndarray, w: np.ndarray, rows: np.ndarray) -> int:
        """Of a few rows the one whose distances to others differ most."""
        few, others = rows[:: max(1, len(rows) // 8)][:8], rows[:: max(1, len(rows) // 256)]
        away = np.sqrt(((x[few][:, None] - x[others][None]) ** 2).sum(2) + (w[few][:, None] - w[others][None]) ** 2)
        return int(few[away.std(1).argmax()])

    def away(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Distances of rows to all vantage points."""
        squares = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None] - 2 * (x @ self.points.T) + (w[:, None] - self.added[None]) ** 2
        return np.sqrt(np.maximum(squares, 0))

    def leaf_of(self, away: np.ndarray) -> np.ndarray:
        at, n = np.zeros(len(away), np.int64), np.arange(len(away))
        for _ in range(self.depth):
            at = 2 * at + 1 + (away[n, at] > self.radii[at])
        return at - ((1 << self.depth) - 1)

    def least(self, away: np.ndarray) -> np.ndarray:
        """[row, leaf]: what the distance of anything in the leaf is at least."""
        bound = np.zeros((len(away), 1))
        for level in range(self.depth):
            first = (1 << level) - 1
            gap = away[:, first : 2 * first + 1] - self.radii[None, first : 2 * first + 1]
            bound = np.stack([np.maximum(bound, gap), np.maximum(bound, -gap)], 2).reshape(len(away), -1)
        return bound


def added_component(squares: np.ndarray, largest: float) -> np.ndarray:
    return np.sqrt(np.maximum(largest - squares, 0))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, ends = np.asarray(column.flatten()).astype(np.float64), np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - ends[rows]] = flat
    return out


def _kept(score: np.ndarray, row: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """[query, place]: which k of each query's candidates are best, ties to the smaller id in ``least``[row]; -1 fills."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(score, at, 1).min(1)
    tied = np.flatnonzero(((score >= last[:, None]).sum(1) > k) & (last > -np.inf))
    for i in tied:
        at[i] = np.lexsort((least[row[i]], -score[i]))[:k]
    return at


def search_shard(x: np.ndarray, least: np.ndarray, q: np.ndarray, worst: np.ndarray, largest: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, score, comparisons): [query, place] the k best rows of ``x`` for each ``q``; -1 where there are fewer.

    worst: squared distances that results must not exceed, from what is known of other shards.
    """
    w = added_component((x * x).sum(1), largest)
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
    tree = VantageTree(x, w, depth)
    base = (q * q).sum(1) + largest
    away = tree.away(q, np.zeros(len(q)))
    bound, own = tree.least(away), tree.leaf_of(away)
    slack = SLACK * np.sqrt(base)
    row, score = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
    limit, compared = np.sqrt(worst), 0

    def visit(who: np.ndarray, leaf: int) -> None:
        nonlocal compared
        rows = tree.members[leaf]
        if not len(who) or not len(rows):
            return
        compared += len(who) * len(rows)
        s = np.concatenate([score[who], q[who] @ x[rows].T], 1)
        r = np.concatenate([row[who], np.broadcast_to(rows, (len(who), len(rows)))], 1)
        at = _kept(s, r, least, k)
        score[who], row[who] = np.take_along_axis(s, at, 1), np.take_along_axis(r, at, 1)
        last = score[who].min(1)
        limit[who] = np.minimum(limit[who], np.where(last > -np.inf, np.sqrt(np.maximum(base[who] - 2 * last, 0)), np.inf))

    for leaf in range(len(tree.members)):
        visit(np.flatnonzero(own == leaf), leaf)
    for leaf in range(len(tree.members)):
        visit(np.flatnonzero((own != leaf) & (bound[:, leaf] * factor <= limit + slack)), leaf)
    exact = np.where(row >= 0, np.einsum("ij,ikj->ik", q, x[np.maximum(row, 0)]) if len(q) * k * x.shape[1] < 1 << 24 else np.stack([(q * x[np.maximum(row[:, j], 0)]).sum(1) for j in range(k)], 1), -np.inf)
    return row, exact, compared


def _search(width: int, largest: float, k: int, factor: float):
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.bool_(), pa.int64()]

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query", "ids", "score", "own", "compared"]
        if not shard.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        column = lambda t, c: t[c].combine_chunks()
        x, q = as_matrix(column(shard, "x"), width), as_matrix(column(asked, "x"), width)
        row, score, compared = search_shard(x, np.asarray(shard["least"]), q, np.asarray(asked["worst"]), largest, k, factor)
        who, place = np.nonzero(row >= 0)
        rows = row[who, place]
        query, own = np.asarray(asked["class"])[who], np.asarray(shard["class"])[rows]
        ids = column(shard, "ids").take(pa.array(rows))
        many = np.zeros(len(who), np.int64)
        many[:1] = compared
        return pa.Table.from_arrays([pa.array(query), ids, pa.array(score[who, place]), pa.array(query == own), pa.array(many)], names)

    return run


def _routed(width: int, largest: float, tree: VantageTree, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("vector_search")
        for batch in batches:
            x = as_matrix(batch["x"], width)
            w = np.zeros(len(x)) if query else added_component((x * x).sum(1), largest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf_of(tree.away(x, w)))], [*batch.schema.names, "cell"])

    return run


def _others(width: int, largest: float, tree: VantageTree, factor: float):
    """The cells besides its own that a query's bound does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = as_matrix(batch["x"], width)
                bound = tree.least(tree.away(x, np.zeros(len(x))))
                base = (x * x).sum(1) + largest
                open_ = bound * factor <= np.sqrt(np.asarray(batch["worst"]))[:, None] + SLACK * np.sqrt(base)[:, None]
                open_[np.arange(len(x)), np.asarray(batch["cell"])] = False
                who, cell = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(who)) for c in ("class", "x", "worst")), pa.array(cell)], ["class", "x", "worst", "cell"])

    return run


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(class, x, ids): each distinct vector of rows (vec_id, x) with at most k + 1 least ids."""
    once = rows.groupBy("x", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.asc_nulls_last("vec_id")))
    least = once.withColumn("place", place).filter(F.col("place") <= k + 1)
    return least.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id"))).alias("ids")).select(F.monotonically_increasing_id().alias("class"), "x", F.col("ids.vec_id").alias("ids"))


def merged(hits: DataFrame, k: int) -> DataFrame:
    """(query, hits): for each query its k + 1 best rows (score, vec_id, own), best first."""
    rows = hits.select("query", "score", "own", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    rows = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    return rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "own"))).alias("hits"))


def nearest(df: DataFrame, asks: Column, k: int = 20, factor: float = 1.0, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows to each row for which ``asks`` holds, by vec_id."""
    zero = F.forall(vector, lambda v: v == 0)
    rows = df.filter(finite(F.col(vector)) & ~zero).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    asking = rows.filter(asks & F.col("vec_id").isNotNull())
    asked = asking.groupBy("x").agg(F.count("*").alias("n"))
    classes = stored(distinct_vectors(rows, k).join(asked, "x", "left"), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    told = classes.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(square).alias("largest"), F.sum("n").alias("asking")).first()
    n, width, largest = told["n"], told["width"] or 1, told["largest"] or 0.0

    sample = classes.filter(F.pmod(F.xxhash64("class"), F.lit(1 << 20)) < (1 << 21) * SAMPLE / max(n, 1)).select("x").limit(SAMPLE).toArrow()
    x = as_matrix(sample["x"].combine_chunks(), width) if sample.num_rows else np.zeros((0, width))
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / CELL)), 0, np.log2(CELLS)))
    tree = VantageTree(x, added_component((x * x).sum(1), largest), depth)

    kind = classes.schema["x"].dataType.simpleString()
    routed = classes.select("class", "x", "ids").mapInArrow(_routed(width, largest, tree, False), f"class long, x {kind}, ids array<long>, cell long")
    index = stored(routed, "cells")
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # a row per cell

    def probed(queries: DataFrame) -> DataFrame:
        """Hits of queries (class, x, worst, cell) in the shards of their cells."""
        blocks = {r["cell"]: -(-r["count"] // BLOCK) for r in queries.groupBy("cell").count().collect()}
        plan = [(c, -(-size // SHARD), blocks[c]) for c, size in sizes.items() if c in blocks]
        cells = F.broadcast(df.sparkSession.createDataFrame(plan, "cell long, shards long, blocks long"))
        dealt = lambda many: F.pmod(F.xxhash64("class"), F.col(many))
        each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
        stock = index.join(cells, "cell").select("cell", dealt("shards").alias("shard"), each("blocks").alias("block"), "class", "x", "ids", F.coalesce(F.col("ids")[0], F.lit((1 << 63) - 1)).alias("least"))
        wanted = queries.join(cells, "cell").select("cell", each("shards").alias("shard"), dealt("blocks").alias("block"), "class", "x", "worst")
        key = ["cell", "shard", "block"]
        return stock.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(_search(width, largest, k + 1, factor), "query long, ids array<long>, score double, own boolean, compared long")

    queries = classes.filter("n is not null").select("class", "x", F.lit(float("inf")).alias("worst"))
    queries = stored(queries.mapInArrow(_routed(width, largest, tree, True), f"class long, x {kind}, worst double, cell long"), "queries")
    home = stored(probed(queries), "home")
    bounds = merged(home, k).select(F.col("query").alias("class"), F.when(F.size("hits") == k + 1, F.col("hits")[k]["score"]).alias("last"))
    known = queries.drop("worst").join(bounds, "class", "left").withColumn("worst", F.coalesce(F.greatest(square + largest - 2 * F.col("last"), F.lit(0.0)), F.lit(float("inf"))))
    others = known.select("class", "x", "worst", "cell").mapInArrow(_others(width, largest, tree, factor), f"class long, x {kind}, worst double, cell long")
    away = stored(probed(stored(others, "others")), "away") if depth else home.limit(0)
    best = merged(home.union(away), k)
    answers = stored(classes.filter("n is not null").join(best, F.col("class") == F.col("query")).select("x", "n", "hits"), "answers")
    found = looked_up(asking, answers, "x", "n", told["asking"] or 0)
    theirs = F.filter("hits", lambda h: ~(h["own"] & F.coalesce(h["vec_id"] == F.col("vec_id"), F.lit(False))))
    ranked = found.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(theirs, 1, k)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
