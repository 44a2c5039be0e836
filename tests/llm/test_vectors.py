"""The vector operators against brute force: whole tables, ties, copies, odd rows, many shards."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import vector_codes as C
from strandloom.llm import vector_search as S

SCHEMA = "vec_id long, embedding array<float>, label int, class string, x int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


# --- search ---------------------------------------------------------------


def brute_nearest(rows, k=20):
    kept = sorted({(i, tuple(map(float, v))) for i, v, *_ in rows if usable(v) and any(v)}, key=lambda r: (r[0] is None, r[0] or 0))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, *_ in rows:
        if i is None or i % 20 or not usable(v) or not any(v):
            continue
        v = tuple(map(float, v))
        found = sorted(((dot(v, y), j) for j, y in kept if (j, y) != (i, v)), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def nearest(spark, rows, **more):
    return sorted((tuple(r) for r in S.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, **more).collect()), key=str)


def whole_vectors(rng, n, dim=8):
    return [[float(c) for c in v] for v in rng.integers(-4, 5, (n, dim))]


@pytest.mark.parametrize("seed", range(6))
def test_shard_search_is_exact_at_factor_one(seed, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 4)
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-3, 4, (200, 5)).astype(float), rng.integers(-3, 4, (30, 5)).astype(float)
    least = rng.permutation(200)
    row, score, _ = S.search_shard(x, least, q, np.full(30, np.inf), float((x * x).sum(1).max()), 7, 1.0)
    for i in range(30):
        right = sorted(range(200), key=lambda r: (-float(q[i] @ x[r]), least[r]))[:7]
        assert sorted(row[i].tolist()) == sorted(right)
        assert sorted(score[i]) == sorted(float(q[i] @ x[r]) for r in right)


def test_relaxed_factor_compares_less_and_finds_most(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, none = x[::20], np.full(200, np.inf)
    exact, _, all_of = S.search_shard(x, np.arange(4000), q, none, 1.0001, 21, 1.0)
    relaxed, _, fewer = S.search_shard(x, np.arange(4000), q, none, 1.0001, 21, 2.0)
    recall = np.mean([len(set(a) & set(b)) / 21 for a, b in zip(exact, relaxed, strict=True)])
    assert fewer < 0.7 * all_of < 0.7 * 200 * 4000 and recall >= 0.9


@pytest.mark.parametrize("sizes", [{}, {"CELL": 64, "SHARD": 50, "BLOCK": 7, "SAMPLE": 100}])
def test_search_over_cells_shards_and_blocks(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, v, 0) for i, v in enumerate(whole_vectors(rng, 400))]
    hot = [2.0, 1.0, -3.0, 0.0, 4.0, 1.0, 1.0, 0.0]
    rows += [(i, hot, 0) for i in range(1000, 1200)]  # copies: a third of all rows
    assert nearest(spark, rows) == brute_nearest(rows)


def test_search_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v, 1) for i, v in enumerate(whole_vectors(rng, 60))]
    rows += [(60, None, 1), (80, [], 1), (100, [0.0] * 8, 1), (120, [1.0, None], 1), (140, [float("nan")] * 8, 1), (160, [float("inf")] * 8, 1)]
    rows += [(180, [1.0, 2.0], None), (181, [1.0] * 8, 3), (181, [1.0] * 8, 3), (200, [1.0] * 8, 3), (200, [2.0] * 8, 3), (None, [3.0] * 8, 3), (None, None, None)]
    assert nearest(spark, rows) == brute_nearest(rows)


def test_search_of_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (7, [0.5, 0.5], 0)]
    assert nearest(spark, rows) == brute_nearest(rows)
    assert nearest(spark, rows[:1]) == [] and nearest(spark, rows[2:]) == []
    assert S.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).collect() == []


# --- codes ----------------------------------------------------------------


def brute_codes(rows, rounds=4, entries=256):
    kept = [(i, v, lab) for i, v, lab in rows if usable(v)]
    longest = max((len(v) for _, v, _ in kept), default=4)
    p = -(-longest // 4)
    whole = [(i, [max(-C.LIMIT, min(C.LIMIT, math.floor(1024 * float(np.float32(c))))) for c in v], lab) for i, v, lab in kept]
    start = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [(v + [0] * (4 * p - len(v)))[j * p : (j + 1) * p] for j in range(4)]
    books = [[cut(v)[j] for _, v, _ in start] for j in range(4)]
    parts = [cut(v) for _, v, _ in whole]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((gap(x, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for j in range(4):
            own = defaultdict(list)
            for x in parts:
                own[best(x[j], books[j])[1]].append(x[j])
            books[j] = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if n in own else e for n, e in enumerate(books[j])]
    told, errors = [], defaultdict(int)
    for (i, _, lab), x in zip(whole, parts, strict=True):
        found = [best(x[j], books[j]) for j in range(4)]
        told.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), lab))
        errors[lab] += told[-1][2]
    said = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, e, errors[lab], said) for i, code, e, lab in told), key=str)


def codes(spark, rows):
    return sorted((tuple(r) for r in C.compress(frame(spark, rows)).collect()), key=str)


def test_codes_with_bounds_as_without(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(c) for c in v], int(i) % 3 or None) for i, v in zip(rng.permutation(420), rng.normal(size=(420, 8)), strict=True)]
    rows += [(i, rows[0][1], 1) for i in range(500, 640)]  # copies under one hot label
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_with_ties_and_unused_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) / 512 for c in v], 1) for i, v in enumerate(rng.integers(-2, 3, (350, 8)))]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = [(5, [0.1] * 7, 1), (5, [0.2] * 8, 1), (5, [0.2] * 8, None), (None, [3e38, -3e38] * 4, 2), (1, [1.0, 2.0], 1), (2, None, 1), (3, [], 1)]
    rows += [(4, [1.0, None], 1), (6, [float("nan")] * 8, 1), (7, [float("inf")] * 8, 1), (8, [0.0] * 8, None), (9, [-0.0001] * 8, None)]
    assert codes(spark, rows) == brute_codes(rows)
    assert C.compress(frame(spark, rows).limit(0)).collect() == []
    assert C.compress(frame(spark, rows[5:8])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_never_change_an_assignment_and_save_comparisons(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-1000, 1000, (64, 4))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-20, 21, (3000, 4))
    book = x[:64].copy()
    at, upper, lower, _ = C.Book(book, None).first(x)
    for _ in range(4):
        new = book.copy()
        for e in range(64):
            if (at == e).any():
                new[e] = x[at == e].sum(0) // (at == e).sum()
        packed, step = C._packed(lower)
        lower = packed.astype(float) * step[:, None].astype(float)
        at, upper, lower, taken = C.Book(new, book).later(x, at, upper, lower)
        squares = C.distances(x, new)
        assert (at == squares.argmin(1)).all()
        assert (upper.astype(float) >= np.sqrt(squares.min(1))).all() and (lower <= np.sqrt(squares)).all()
        assert taken < squares.size
        book = new
    assert taken < 0.2 * squares.size
