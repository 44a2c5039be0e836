import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import packing, simhash
from strandloom.llm.components import components

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "é", "cc"]), max_size=30).map(" ".join))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("part", [8192, 40])
def test_links_of_random_and_dense_fingerprints(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(part)
    far = [rng.getrandbits(64) for _ in range(200)]
    dense = [far[0] ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(300)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in far[1:120]]
    fps = sorted(set(far + dense + near))
    exact = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    at = {f: i for i, f in enumerate(fps)}
    got = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in simhash.fingerprint_links(rows, len(fps)).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in got)
    assert roots(len(fps), got) == roots(len(fps), exact)


def test_pivots_bound_distances():
    pivots = simhash.pivot_fingerprints()
    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        d = np.abs(np.bitwise_count(np.uint64(a) ^ pivots).astype(int) - np.bitwise_count(np.uint64(b) ^ pivots).astype(int))
        assert d.max() <= (a ^ b).bit_count() and (d**2).sum() == 64 * (a ^ b).bit_count()


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices(["the", "of", "cat", "dog", "ran", "sat", "mat", "hat"], k=400)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[0]) for i in range(50)] + [(200, base[1] + " end"), (300, None), (301, ""), (302, " \n"), (None, base[2]), (100, base[0])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumnRenamed("text", "text")).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    group = roots(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    expected = sorted((str(d), f"{f:016x}", least.get(g)) for (d, _), f, g in zip(rows, fps, group, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expected
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_of_long_texts_beside_other_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(9, long, "f", 1), (3, long, "f", 1), (4, long + " w5 w6", "f", 1), (7, "other words", "f", 1)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS + ", fp string, component int")).collect()}
    assert {d: c for d, (_, c) in got.items()} == {9: 3, 3: 3, 4: 3, 7: 7} and got[9][0] == f"{brute_fingerprint(long):016x}"


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(pairs).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000 and len(got) == 303
    assert components(pairs.limit(0)).count() == 0


# Packing.


def by_length(lengths):
    return np.argsort(-lengths, kind="stable")


def check_packing(p, lengths, capacity):
    assert sorted(set(p.bin_of.tolist())) == list(range(len(p.fill)))
    assert (np.bincount(p.bin_of, lengths) == p.fill).all() and p.fill.max() <= capacity


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60), st.integers(0, 5))
def test_evolution_packs_everything_once(lengths, seed):
    lengths = np.array(lengths)
    bred = packing.evolve(lengths, [], 100, seed)
    greedy = packing.best_fit(lengths, by_length(lengths), 100)
    check_packing(bred, lengths, 100), check_packing(greedy, lengths, 100)
    assert greedy.fitness() <= bred.fitness() <= packing.ideal(lengths, 100)
    again = packing.evolve(lengths, [bred.bin_of], 100, seed + 1)
    assert again.fitness() >= bred.fitness()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=2, max_size=60), st.integers(0, 10**6))
def test_children_of_any_parents_are_packings(lengths, seed):
    lengths, rng = np.array(lengths), np.random.default_rng(seed)
    one, other = (packing.best_fit(lengths, rng.permutation(len(lengths)), 100) for _ in range(2))
    check_packing(packing.crossed(one, other, lengths, 100, rng), lengths, 100)


def triples(n, seed, capacity=100):
    """Pieces that fill n bins by threes."""
    rng, lengths = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(capacity // 5, capacity * 9 // 20)
        b = rng.randint(capacity // 5, capacity - 1 - a)
        lengths += [a, b, capacity - a - b]
    rng.shuffle(lengths)
    return np.array(lengths)


def test_crossover_beats_best_fit_alone():
    lengths = triples(60, 5)
    greedy = packing.best_fit(lengths, by_length(lengths), 100)
    bred = packing.evolve(lengths, [], 100, 1, population=10, generations=60)
    assert bred.fitness() > greedy.fitness() and len(bred.fill) <= 61


def test_migrants_are_bred_further():
    better = 0
    for k in range(6):
        lengths = triples(100, k, 1000)
        islands = [packing.evolve(lengths, [], 1000, seed) for seed in (1, 2)]
        after = packing.evolve(lengths, [p.bin_of for p in islands], 1000, 3)
        best = max(p.fitness() for p in islands)
        assert after.fitness() >= best
        better += after.fitness() > best
    assert better >= 2


def test_generations_change_the_packing_of_a_table(spark, monkeypatch):
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(triples(100, 3, 1000))], "row long, length long")
    fitness = []
    for generations in (0, 6):
        monkeypatch.setattr(packing, "evolve", lambda *a, evolve=EVOLVE, g=generations: evolve(*a, generations=g))
        out = packing.pack(rows, 1000).toPandas()
        assert sorted(out["row"]) == list(range(300))
        fills = out.merge(rows.toPandas(), on="row").groupby("sequence_id")["length"].sum()
        assert fills.max() <= 1000
        fitness.append((-len(fills), (fills**2).sum()))
    assert fitness[0] < fitness[1]


@pytest.mark.parametrize("length", [60, 99])
def test_levels_end_where_no_bin_can_be_closed(spark, monkeypatch, length):
    monkeypatch.setattr(packing, "SHARD", 20)
    out = packing.pack(spark.range(500).selectExpr("id as row", f"cast({length} as long) as length"), 100).toPandas()
    assert len(out) == out["sequence_id"].nunique() == out["row"].nunique() == 500 and not out["offset"].any()


def test_tiny_pieces_end_in_full_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    out = packing.pack(spark.range(5000).selectExpr("id as row", "1L as length"), 100).toPandas()
    assert out["sequence_id"].nunique() <= 53 and (out.groupby("sequence_id")["offset"].max() < 100).all()


EVOLVE = packing.evolve


def test_packing_of_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    from tokenizers import Tokenizer

    from strandloom.llm.tokens import vocabulary_path

    rng = random.Random(2)
    words = ["thing", "Word", "naïve", "x,", "don't", "42", "漢字", "<|endoftext|>", "İ"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(180)] + [(500, None), (501, ""), (None, "word"), (3, "again"), (600, "word " * 300), (601, "word " * 63)]
    out = packing.best_fit_packing(spark.createDataFrame(rows, DOCS), capacity=64).toPandas()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    import zlib

    expected = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected.append((str(d), k, at, len(part), zlib.crc32(part.tobytes())))
    got = sorted(("None" if r.doc_id != r.doc_id or r.doc_id is None else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == sorted(expected)
    for _, rows_ in out.sort_values("offset").groupby("sequence_id"):
        assert rows_["offset"].tolist() == [0, *rows_["length"].cumsum().tolist()[:-1]] and rows_["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 64) + 2
    assert packing.best_fit_packing(spark.createDataFrame([], DOCS)).count() == 0
