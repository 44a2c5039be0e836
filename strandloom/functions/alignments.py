"""Alignments and common runs of many pairs of calls at a time, as arrays.

The distinct pairs of an Arrow batch are sorted by size and laid side by side, as many as have
``CELLS`` cells together. All their matrices are filled at once, one anti-diagonal after another for alignments and one
row after another for common runs, and traced back at once, one step after another. So the
number of Python steps follows the length of the longest pair, not the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALIGNMENT = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
_RUN = T.StructType([T.StructField("run", T.ArrayType(T.StringType()))] + [T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")])

CELLS = 4_000_000
#: Steps of an alignment: a pair, a call of the first row beside a gap, one of the second beside a gap.
PAIR, FIRST, SECOND = 0, 1, 2


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts and ends of the lists, and their items one after another."""
    ends = np.asarray(column.offsets)
    return ends[:-1] - ends[0], ends[1:] - ends[0], column.flatten()


def _chunks(x: pa.Array, y: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first of them, X, Y, lengths of X, of Y) with items as numbers from 0, -1 and -2 behind the ends; rows: places in the batch, each of a distinct pair."""
    (a, b, left), (c, d, right) = _lists(x), _lists(y)
    both = pa.chunked_array([left.cast(pa.string()), right.cast(pa.string())]).combine_chunks().dictionary_encode()
    codes = np.asarray(both.indices.fill_null(-3)).astype(np.int64)
    words, xs, ys = both.dictionary, codes[: len(left)], codes[len(left) :]
    seen: dict[tuple[bytes, bytes], int] = {}
    same = np.empty(len(a), np.int64)
    for i in range(len(a)):
        same[i] = seen.setdefault((xs[a[i] : b[i]].tobytes(), ys[c[i] : d[i]].tobytes()), i)
    own = np.flatnonzero(same == np.arange(len(a)))
    n, m = b - a, d - c
    own = own[np.lexsort((m[own], n[own]))]
    at = 0
    while at < len(own):
        stop, most = at + 1, [n[own[at]], m[own[at]]]
        while stop < len(own):
            most = [max(most[0], n[own[stop]]), max(most[1], m[own[stop]])]
            if (stop + 1 - at) * (most[0] + 1) * (most[1] + 1) > CELLS:
                break
            stop += 1
        rows = own[at:stop]
        wide = lambda starts, sizes, items, none: np.array([np.pad(items[s : s + z], (0, int(sizes.max()) - z), constant_values=none) for s, z in zip(starts, sizes, strict=True)], np.int64).reshape(len(starts), -1)
        yield rows, same, wide(a[rows], n[rows], xs, -1), wide(c[rows], m[rows], ys, -2), n[rows], m[rows], words
        at = stop


def _steps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[pair, i, j]: the last step of the best alignment of the first i and j calls.

    1 for equal calls, 0 for others, -1 a gap; the first gap at either border is free. Among
    equally good steps a gap in the first row goes before one in the second, and that before a pair.
    """
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    step = np.zeros((pairs, n + 1, m + 1), np.int8)
    step[:, 1:, 0], step[:, 0, 1:] = FIRST, SECOND
    best = {0: np.zeros((pairs, n + 1), np.int32), -1: np.zeros((pairs, n + 1), np.int32)}  # of a diagonal, by i
    for s in range(1, n + m + 1):
        now = np.empty((pairs, n + 1), np.int32)
        now[:, 0] = now[:, min(s, n)] = 1 - s
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        if len(i):
            up, left, across = best[s - 1][:, i - 1] - 1, best[s - 1][:, i] - 1, best[s - 2][:, i - 1] + (x[:, i - 1] == y[:, s - i - 1])
            score, how = across, np.zeros(across.shape, np.int8)
            for other, name in ((up, FIRST), (left, SECOND)):
                better = other >= score
                score, how = np.where(better, other, score), np.where(better, np.int8(name), how)
            now[:, i] = score
            step[:, i, s - i] = how
        if s <= n:
            now[:, s] = 1 - s
        if s <= m:
            now[:, 0] = 1 - s
        best = {s: now, s - 1: best[s - 1]}
    return step


def align_batch(x: pa.Array, y: pa.Array) -> pa.Array:
    """Of each pair of lists its alignment, array<struct<a, b>> with gaps as *."""
    size, found = len(x), {}
    same = np.arange(size)
    words: list[str] = []
    for rows, same, a, b, n, m, dictionary in _chunks(x, y):
        words = dictionary.to_pylist()
        step, k = _steps(a, b), np.arange(len(rows))
        i, j, columns = n.astype(np.int64), m.astype(np.int64), []
        while (i + j).any():
            how, more = step[k, i, j], (i + j) > 0
            in_a, in_b = more & (how != SECOND), more & (how != FIRST)
            columns.append((np.where(in_a, a[k, np.maximum(i - 1, 0)] if a.shape[1] else -1, -1), np.where(in_b, b[k, np.maximum(j - 1, 0)] if b.shape[1] else -1, -1), more))
            i, j = i - in_a, j - in_b
        left, right, there = (np.array([c[z] for c in columns]).reshape(len(columns), len(rows)) for z in range(3))
        for at, row in enumerate(rows.tolist()):
            own = there[:, at].astype(bool)
            found[row] = (left[own, at][::-1], right[own, at][::-1])
    parts = [found[r] for r in same.tolist()] if size else []
    ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
    names = pa.array([*words, "*", None], pa.string())
    column = lambda z: names.take(pa.array(_named(np.concatenate([p[z] for p in parts]) if parts else np.zeros(0, np.int64), len(words))))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([column(0), column(1)], ["a", "b"]))


def _named(codes: np.ndarray, words: int) -> np.ndarray:
    """Places in the words, of which the last two are a gap and null."""
    return np.where(codes >= 0, codes, np.where(codes == -3, words + 1, words)).astype(np.int64)


def common_run_batch(x: pa.Array, y: pa.Array) -> pa.Array:
    """Of each pair of lists the first of their longest common runs, and where it starts and ends in each."""
    out = np.zeros((len(x), 5), np.int64)  # length, its place in x and y
    same = np.arange(len(x))
    for rows, same, a, b, n, m, _ in _chunks(x, y):
        best = np.zeros((len(rows), 3), np.int64)
        above = np.zeros((len(rows), b.shape[1] + 1), np.int64)
        for i in range(a.shape[1]):
            now = np.zeros_like(above)
            now[:, 1:] = np.where(a[:, i, None] == b, above[:, :-1] + 1, 0)
            j = now.argmax(1)
            length = now[np.arange(len(rows)), j]
            better = length > best[:, 0]
            best[better] = np.stack([length, np.full(len(rows), i), j - 1], 1)[better]
            above = now
        some = best[:, 0] > 0
        out[rows] = np.stack([best[:, 0], best[:, 1] - best[:, 0] + 1, best[:, 1], best[:, 2] - best[:, 0] + 1, best[:, 2]], 1) * some[:, None]
    out = out[same] if len(x) else out
    starts, _, items = _lists(x) if len(x) else (np.zeros(0, np.int64), None, pa.array([], pa.string()))
    ends = np.concatenate([[0], np.cumsum(out[:, 0])]).astype(np.int32)
    taken = np.repeat(starts + out[:, 1], out[:, 0]) + np.arange(ends[-1]) - np.repeat(ends[:-1], out[:, 0])
    run = pa.ListArray.from_arrays(pa.array(ends), items.cast(pa.string()).take(pa.array(taken.astype(np.int64))))
    return pa.StructArray.from_arrays([run, *(pa.array(out[:, c].astype(np.int32)) for c in range(1, 5))], ["run", "a_start", "a_end", "b_start", "b_end"])


@F.arrow_udf(_ALIGNMENT)
def align_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    return align_batch(x, y)


@F.arrow_udf(_RUN)
def common_run_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    return common_run_batch(x, y)
