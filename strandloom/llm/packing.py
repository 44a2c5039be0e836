"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are encoded, closed by an end token, and cut only where longer than the capacity.
Full pieces are sequences of their own. All shorter ones are dealt out by hash to shards of
about ``SHARD`` pieces, one row each. Each shard is bred on ``ISLANDS`` islands. An island
starts with best-fit packings of shaken orders; crossover injects well-filled bins of one
parent whole into the other, drops the bins that hold the same pieces, dissolves the emptiest
ones, lets loose pieces take the place of shorter ones where that fills a bin up, and best-fits
what is left over. Fitness is Falkenauer's: fewer bins, then the
sum of squared fills, which still tells packings of equally many bins apart, as it gathers
what is left free in few bins. After each epoch the best packing of every island
migrates to all islands of its shard.

Bins filled to ``CLOSED`` of the capacity become sequences. So do the fullest others, until
half of the shard's pieces are left at most; these are dealt out anew to fewer shards and bred
with the leftovers of other shards. Each level has half of the pieces of the one before at
most, so it ends with one shard at any size, and no task holds more than about a shard.

Null texts are empty: one end token. Null and repeated doc_ids are packed like others; rows
are told apart by a number of their own. A text of any length is whole pieces and a last one.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import dropped, stored, worker_cache
from strandloom.llm.tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096
SHARD, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, GENERATIONS = 6, 6
CLOSED = 0.985
#: Bins of a shard at least, so that tiny pieces don't end up in shards of one bin.
LEAST_BINS = 16
#: Texts that a task encodes together; what they need beside the kept words is to stay small.
ROWS = 1000
#: Part of a shard's pieces that goes on to the next level at most.
LEFT_OVER = 0.5


class Packing(NamedTuple):
    """The bin of each piece, and how full each bin is."""

    bin_of: np.ndarray
    fill: np.ndarray

    def fitness(self) -> tuple[int, int]:
        return -len(self.fill), int(self.fill @ self.fill)


def best_fit(lengths: np.ndarray, order: Iterable[int], capacity: int, start: Packing | None = None) -> Packing:
    """Put each piece into the fullest bin that has room; a bit mask holds which free spaces occur."""
    bin_of = np.full(len(lengths), -1, np.int32) if start is None else start.bin_of
    fills: list[int] = [] if start is None else start.fill.tolist()
    free_at: dict[int, list[int]] = {}
    mask = 0
    for b, fill in enumerate(fills):
        if fill < capacity:
            free_at.setdefault(capacity - fill, []).append(b)
            mask |= 1 << (capacity - fill)
    order = list(order)
    put = []
    for n in lengths[order].tolist():
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            at = free_at[free]
            b = at.pop()
            if not at:
                mask ^= 1 << free
            fills[b] += n
        else:
            free, b = capacity, len(fills)
            fills.append(n)
        put.append(b)
        if free > n:
            free_at.setdefault(free - n, []).append(b)
            mask |= 1 << (free - n)
    bin_of[order] = put
    return Packing(bin_of, np.array(fills, np.int64))


def ideal(lengths: np.ndarray, capacity: int) -> tuple[int, int]:
    """The fitness that no packing exceeds: all bins full but one."""
    full, rest = divmod(int(lengths.sum()), capacity)
    return -(full + (rest > 0)), full * capacity * capacity + rest * rest


def swapped_in(lengths: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, capacity: int) -> None:
    """Fill bins up from the loose pieces: a piece of a bin gives way to the longest loose one that also fits there."""
    at: dict[int, list[int]] = {}
    mask = 0
    loose = np.flatnonzero(bin_of < 0)
    for i, n in zip(loose.tolist(), lengths[loose].tolist(), strict=True):
        at.setdefault(n, []).append(i)
        mask |= 1 << n
    inside = np.flatnonzero(bin_of >= 0)
    inside = inside[fill[bin_of[inside]] < capacity]
    for i, n, b in zip(inside.tolist(), lengths[inside].tolist(), bin_of[inside].tolist(), strict=True):
        room = capacity - int(fill[b])
        better = (mask >> (n + 1)) & ((1 << room) - 1)
        if better:
            more = n + better.bit_length()
            j = at[more].pop()
            if not at[more]:
                del at[more]
                mask ^= 1 << more
            at.setdefault(n, []).append(i)
            mask |= 1 << n
            bin_of[i], bin_of[j] = -1, b
            fill[b] += more - n


def crossed(one: Packing, other: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """A child: bins of ``other`` injected into ``one``, and what they displace put in by best fit."""
    ranked = np.lexsort((rng.random(len(other.fill)), -other.fill))
    ranked = ranked[: max(1, int(len(ranked) * rng.uniform(0.005, 0.1)))]
    injected = np.zeros(len(other.fill), bool)
    injected[ranked[rng.random(len(ranked)) < 0.9]] = True
    inside = injected[other.bin_of]
    broken = np.zeros(len(one.fill), bool)
    broken[one.bin_of[inside]] = True
    whole = np.flatnonzero(~broken)
    broken[whole[np.argsort(one.fill[whole], kind="stable")[: 1 + len(whole) // 50]]] = True  # mutation: the emptiest are dissolved
    kept = np.cumsum(~broken) - 1
    came = np.cumsum(injected) - 1 + (~broken).sum()
    bin_of = np.where(inside, came[other.bin_of], np.where(broken[one.bin_of], -1, kept[one.bin_of])).astype(np.int32)
    fill = np.concatenate((one.fill[~broken], other.fill[injected]))
    swapped_in(lengths, bin_of, fill, capacity)
    loose = np.flatnonzero(bin_of < 0)
    return best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], capacity, Packing(bin_of, fill))


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing that one island breeds from the elites that came in and packings of its own."""
    rng, best = np.random.default_rng(seed), ideal(lengths, capacity)
    pool = [Packing(e, np.bincount(e, lengths).astype(np.int64)) for e in elites]
    while len(pool) < population:
        noise = 0.05 * len(pool)
        pool.append(best_fit(lengths, np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable"), capacity))
    pool.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if pool[0].fitness() >= best:
            break
        parents = pool[: max(2, population // 2)]
        children = []
        while len(parents) + len(children) < max(population, 3):
            a, b = rng.choice(len(parents), 2, replace=False)
            children.append(crossed(parents[a], parents[b], lengths, capacity, rng))
        pool = sorted(parents + children, key=Packing.fitness, reverse=True)
    return pool[0]


def _breed(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("packing")
        for batch in batches:
            for shard, island, lengths, came in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                elites = [np.frombuffer(e, np.int32) for e in came]
                best = evolve(np.array(lengths, np.int64), elites, capacity, shard * 1009 + island * 31 + epoch)
                n_bins, squares = best.fitness()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (island, pa.int32()), (n_bins, pa.int64()), (squares, pa.int64()), (best.bin_of.tobytes(), pa.binary()))], ["shard", "island", "fewer", "squares", "placed"])

    return run


def _closing(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lengths, rows, placed in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                lengths, rows, bin_of = np.array(lengths, np.int64), np.array(rows, np.int64), np.frombuffer(placed, np.int32)
                fill, held = np.bincount(bin_of, lengths), np.bincount(bin_of)
                emptiest = np.lexsort((np.arange(len(fill)), fill))
                goes_on = (fill < CLOSED * capacity) & (not last)
                goes_on[emptiest] &= np.cumsum(held[emptiest]) <= LEFT_OVER * len(rows)
                order = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(lengths[order])
                offset = ends - lengths[order] - (np.cumsum(fill) - fill)[bin_of[order]].astype(np.int64)
                done = pa.array(~goes_on[bin_of[order]])
                yield pa.RecordBatch.from_arrays([pa.array(rows[order]), pa.array(lengths[order]), pa.array((np.int64(level) << 54) + (np.int64(shard) << 20) + bin_of[order].astype(np.int64)), pa.array(offset), done], ["row", "length", "sequence_id", "offset", "done"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items: row long, length long below the capacity. Returns row, sequence_id, offset for each."""
    parts, level = [], 0
    while True:
        count, tokens = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        shards = max(1, min(-(-count // SHARD), tokens // (LEAST_BINS * capacity)))
        dealt = items.groupBy(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).cast("long").alias("shard"))
        dealt = dealt.agg(F.sort_array(F.collect_list(F.struct("length", "row"))).alias("p")).select("shard", "p.length", "p.row")
        dealt = stored(dealt, "shards")
        spread = min(shards * ISLANDS, 4096)
        found = None
        for epoch in range(EPOCHS):
            came = dealt.withColumn("came", F.array().cast("array<binary>"))
            if found is not None:
                came = dealt.join(found.groupBy("shard").agg(F.sort_array(F.collect_list("placed")).alias("came")), "shard")
            islands = came.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "length", "came").repartition(spread, "shard", "island")
            bred = stored(islands.mapInArrow(_breed(capacity, epoch), "shard long, island int, fewer long, squares long, placed binary"), "islands")
            if found is not None:
                dropped(found)
            found = bred
        best = found.groupBy("shard").agg(F.max(F.struct("fewer", "squares", F.col("island"), "placed")).alias("best"))
        out = dealt.join(best, "shard").select("shard", "length", "row", "best.placed").mapInArrow(_closing(capacity, level, shards == 1), "row long, length long, sequence_id long, offset long, done boolean")
        out = stored(out, "packed")
        dropped(found), dropped(dealt)
        parts.append(out.filter("done").select("row", "sequence_id", "offset"))
        if shards == 1:
            break
        items, level = out.filter("not done").select("row", "length"), level + 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            coded = encoder(path).encode(batch.column(2).to_pylist())
            out: tuple[list, ...] = ([], [], [], [], [], [])
            step = capacity * 4
            for doc, row, code in zip(ids, rows, coded, strict=True):
                code += end
                for k, at in enumerate(range(0, len(code), step)):
                    part = code[at : at + step]
                    for column, x in zip(out, (doc, row, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (batch.schema.types[0], pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of every piece."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(vocabulary or vocabulary_path(), capacity), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece with the sequence and the offset that it is put at."""
    pieces = stored(token_pieces(docs, text, doc_id, capacity, vocabulary), "pieces")
    full, short = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    placed = pack(short.select("row", "length"), capacity)
    alone = full.select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(placed, "row").unionByName(alone).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
