"""Compression of vectors to short codes: a codebook per part of the vector, fitted by Lloyd's rounds with Elkan's bounds.

Components become integers floor(1024 x). A vector is cut into ``PARTS`` equal consecutive
parts, each with a codebook of at most ``ENTRIES`` entries that starts as that part of the
vectors with the least vec_ids. A round assigns each part to the nearest entry, ties to the
lower index, then moves each entry to floor(sum / count) of its parts.

State is kept between rounds, as a table in the shared folder: for each part of a row the
entry, an upper bound of the distance to it and one lower bound per entry. When entries have
moved, the upper bound grows and each lower bound shrinks by that entry's movement. An entry is
passed over only if its lower bound, or half its distance to the own entry, is strictly above
the upper bound, so it is strictly farther; all others are compared by integers, which is
what decides ties. Lower bounds take a byte each, rounded down in steps of 1/255 of the
part's largest one; upper bounds are rounded up. Rounding costs comparisons, never results.

Rows are dealt as they are read and never by value, so copies, hot labels and any order of
rows leave tasks even. What comes to the driver in a round are sums and counts per entry,
added up on the executors: a thousand rows, whatever the input.

Rows whose vector is null, empty or holds nulls or non-finite components take no part. Vectors shorter
than the longest are filled up with zeros, and so is a length that ``PARTS`` doesn't divide.
Integers beyond ``2 ** 27`` are held there, so that squared distances fit in a long. Among rows with equal
vec_ids the lesser vector starts an entry first; null vec_ids come last; repeated rows count each. With
fewer rows than ``ENTRIES`` there are fewer entries. A label's error that no long can hold is
null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import dropped, looked_up, stored, worker_cache

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
#: Beyond this share of entries left to compare, all of a row's distances are taken at once.
DENSE = 0.2


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components and all of them are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def whole_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, x): the rows that take part, with components as integers."""
    held = lambda v: F.least(F.greatest(F.floor(v.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return df.filter(finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(vector, held).alias("x"))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``book``."""
    largest = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4.0 * x.shape[1] * float(largest) ** 2 < 2.0**53:  # every sum is an integer that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], 1)


def _up(squares: np.ndarray) -> np.ndarray:
    """Distances as floats, not below the true ones."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes and the step of each row."""
    step = (np.maximum(lower.max(1, initial=0), 0) / 255).astype(np.float32)
    safe = np.where(step > 0, step, np.float32(1)).astype(np.float64)
    return np.minimum(lower / safe[:, None] * (1 - 1e-6), 255).astype(np.uint8), step


class Book:
    """One part's entries, their movement since the last round and the gaps between them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None) -> None:
        self.entries = entries
        self.moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        between = np.sqrt(distances(entries, entries).astype(np.float64))
        self.half = between / 2 * (1 - 1e-9)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper, lower, distances taken) without bounds to start from."""
        squares = distances(x, self.entries)
        at = squares.argmin(1)
        lower = np.sqrt(squares.astype(np.float64)) * (1 - 1e-9)
        return at, _up(squares[np.arange(len(x)), at]), lower, squares.size

    def later(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before."""
        at, n, taken = at.copy(), np.arange(len(x)), 0
        upper = np.nextafter((upper.astype(np.float64) + self.moved[at]).astype(np.float32), np.float32(np.inf))
        lower = np.maximum(lower - self.moved[None, :], 0)

        def open_entries(rows: np.ndarray) -> np.ndarray:
            most = upper[rows, None].astype(np.float64)
            left = (lower[rows] <= most) & (self.half[at[rows]] <= most)
            left[np.arange(len(rows)), at[rows]] = False
            return left

        rows = n[open_entries(n).any(1)]
        own = ((x[rows] - self.entries[at[rows]]) ** 2).sum(1)  # bounds are tightened once, where they leave a doubt
        upper[rows], taken = _up(own), len(rows)
        lower[rows, at[rows]] = np.sqrt(own.astype(np.float64)) * (1 - 1e-9)
        left = open_entries(rows)
        some = left.any(1)
        rows, own, left = rows[some], own[some], left[some]
        if not len(rows):
            return at, upper, lower, taken
        if left.mean() > DENSE:
            squares = distances(x[rows], self.entries)
            taken += squares.size
            at[rows] = squares.argmin(1)
            lower[rows] = np.sqrt(squares.astype(np.float64)) * (1 - 1e-9)
            upper[rows] = _up(squares.min(1))
            return at, upper, lower, taken
        r, c = np.nonzero(left)
        squares = np.concatenate([((x[rows[r[i : i + 65536]]] - self.entries[c[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(r), 65536)])
        taken += len(r)
        lower[rows[r], c] = np.sqrt(squares.astype(np.float64)) * (1 - 1e-9)
        r, c, squares = np.r_[r, np.arange(len(rows))], np.r_[c, at[rows]], np.r_[squares, own]
        order = np.lexsort((c, squares, r))
        best = order[np.r_[True, np.diff(r[order]) > 0]]
        at[rows], upper[rows] = c[best], _up(squares[best])
        return at, upper, lower, taken


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of equal width, filled up with zeros."""
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - ends[rows]] = flat
    return out


def _fixed(values: np.ndarray) -> pa.Array:
    """A byte string per row."""
    width = values[0].nbytes if len(values) else 0
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary()) if width else pa.array([b""] * len(values), pa.binary())


def _assign(width: int, books: np.ndarray, before: np.ndarray | None, last: bool):
    """A round over rows (x, code, upper, step, lower, other columns); without bounds where ``before`` is None."""
    p = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("vector_codes")
        made = [Book(books[j], None if before is None else before[j]) for j in range(PARTS)]
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = _matrix(batch["x"], width).reshape(-1, PARTS, p)
                n, k = len(x), books.shape[1]
                if not n:
                    continue
                if before is not None:
                    read = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind)  # noqa: B023, E731
                    code, upper, step = read("code", np.uint8).reshape(n, PARTS), read("upper", np.float32).reshape(n, PARTS), read("step", np.float32).reshape(n, PARTS)
                    lower = read("lower", np.uint8).reshape(n, PARTS, k)
                out = []
                for j in range(PARTS):
                    if before is None:
                        out.append(made[j].first(x[:, j]))
                    else:
                        out.append(made[j].later(x[:, j], code[:, j].astype(np.int64), upper[:, j], lower[:, j].astype(np.float64) * step[:, j, None].astype(np.float64)))
                at = np.stack([o[0] for o in out], 1)
                codes = _fixed(at.astype(np.uint8))
                taken = pa.array(np.full(n, sum(o[3] for o in out) / max(n, 1)))
                if last:
                    error = sum(((x[:, j] - books[j][at[:, j]]) ** 2).sum(1) for j in range(PARTS))
                    columns = [batch["vec_id"], batch["label"], codes, pa.array(error, pa.int64()), taken]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "taken"])
                    continue
                bytes_, steps = zip(*(_packed(o[2]) for o in out), strict=True)
                columns = [batch["vec_id"], batch["label"], batch["x"], codes, _fixed(np.stack([o[1] for o in out], 1)), _fixed(np.stack(steps, 1)), _fixed(np.stack(bytes_, 1)), taken]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "code", "upper", "step", "lower", "taken"])

    return run


def _sums(width: int, entries: int):
    """Sums and counts per part and entry of the rows of a task."""
    p = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, entries, p), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            x = _matrix(batch["x"], width).reshape(-1, PARTS, p)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, PARTS)
            for j in range(PARTS):
                np.add.at(total[j], code[:, j], x[:, j])
                count[j] += np.bincount(code[:, j], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def moved(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The entries of the next round."""
    p = width // PARTS
    sums = state.select("x", "code").mapInArrow(_sums(width, books.shape[1]), "part int, entry int, n long, total array<long>")
    told = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(p)))
    out = books.copy()
    for row in told.collect():  # a row per entry
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(p)]
    return out


def first_books(whole: DataFrame, width: int) -> np.ndarray:
    """Entries of all parts from the rows with the least vec_ids; [part, entry, place]."""
    rows = whole.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    x = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        x[i, : len(row["x"])] = row["x"]
    return np.ascontiguousarray(x.reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2))


def fit(whole: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, taken) of rows (vec_id, label, x), and the final entries.

    code: a byte per part; taken: distances taken for the row in its last round.
    """
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    longest = whole.agg(F.max(F.size("x"))).first()[0] or PARTS
    width = -(-longest // PARTS) * PARTS
    books, before, state = first_books(whole, width), None, whole
    named = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    for _ in range(rounds if books.size else 0):
        step = _assign(width, books, before, False)
        later = stored(state.mapInArrow(step, f"{named}, x array<int>, code binary, upper binary, step binary, lower binary, taken double"), "bounds")
        if before is not None:
            dropped(state)
        state, before, books = later, books, moved(later, books, width)
    return state.mapInArrow(_assign(width, books, before, True), f"{named}, code binary, error long, taken double"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row that takes part; code in hexadecimal."""
    found, books = fit(whole_vectors(df))
    key = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("none"))
    rows = stored(found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", key.alias("group")), "codes")
    errors = rows.groupBy("group").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    # Hot labels are broadcast, so that no task gets all rows of one.
    out = looked_up(rows, stored(errors, "errors"), "group", "n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
