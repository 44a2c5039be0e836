"""A toxicity classifier with counterfactual regularisation over identity terms.

A logistic model over the presence of words and word beginnings is fitted on at most
``SAMPLE`` labelled rows, taken by hash order of their ids. For every sample text that
mentions a group, counterfactuals are made by swapping each identity term for another one, and
for a word that names no group, and the fit is penalised by the squared differences of the
scores' logits, so that the mention of a group by itself moves no score. The features are the ``FEATURES`` with the strongest
association over the sample, and all identity terms.

Scoring reads whole texts, every row, on the executors; the model is a few thousand weights.
Null and empty texts score by the intercept. Labels that are null are no labels; a document
labelled twice is toxic if either label says so. Without labels, or with one class only, the
score is the smoothed rate of the class. Rows with a null doc_id are scored and are not held out.
Of labels only those of ids that occur count towards the sample, and of rows with one id only
the least text is learnt from, so that the sample's bound holds. A text of any length is a set of words.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import worker_cache

SAMPLE, FEATURES = 8000, 2000
LEAST_DOCS = 5
RIDGE, SWAP_PENALTY, STEPS = 0.1, 4.0, 600
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7, 8)
KEPT = 200_000

#: Identity terms by language and kind; swaps stay within a group.
IDENTITY = tuple(
    tuple(g.split())
    for g in (
        "christian muslim jewish hindu buddhist atheist catholic protestant",
        "christians muslims jews hindus buddhists atheists catholics protestants",
        "black white asian latino hispanic african european arab indian mexican chinese",
        "gay lesbian straight bisexual transgender queer heterosexual homosexual",
        "women men girls boys females males",
        "woman man girl boy female male",
        "immigrants refugees foreigners migrants natives citizens",
        "old young elderly disabled blind deaf",
        "femmes hommes filles garçons",
        "musulmans chrétiens juifs athées",
        "frauen männer mädchen jungen",
        "muslime christen juden atheisten",
        "mujeres hombres niñas niños",
        "musulmanes cristianos judíos ateos",
    )
)
_SWAP = {g[i].encode(): g[(i + 1) % len(g)].encode() for g in IDENTITY for i in range(len(g))}

# Everything ASCII but letters and digits becomes a space, capitals become small.
_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_TABLE).split())


def _features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    chars = word.decode()
    parts = [b"=" + word] + [b"^" + chars[:n].encode() for n in BEGINNINGS if len(chars) > n]
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts]


def swapped(words: set[bytes]) -> set[bytes]:
    """Each identity term as the next one of its group."""
    return {_SWAP.get(w, w) for w in words}


def neutral(words: set[bytes]) -> set[bytes]:
    """Each identity term as a word for no group."""
    return {b"people" if w in _SWAP else w for w in words}


@dataclass(frozen=True)
class Model:
    features: dict[int, int]
    weights: np.ndarray
    bias: float

    def logits(self, texts: list[str | None], held: dict[bytes, tuple[int, ...]]) -> list[float]:
        """held: the model's features of words seen before."""
        out = []
        for t in texts:
            found: set[int] = set()
            for w in words_of(t):
                at = held.get(w)
                if at is None:
                    if len(held) > KEPT:
                        held.clear()
                    at = held[w] = tuple(self.features[f] for f in _features(w) if f in self.features)
                if at:
                    found.update(at)
            out.append(self.bias + float(sum(self.weights[list(found)])) if found else self.bias)
        return out


@dataclass(frozen=True)
class Sparse:
    """A matrix by the places and values of its entries."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(lists: list[list[tuple[int, float]]], width: int) -> Sparse:
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = [e for x in lists for e in x]
        return Sparse(rows, np.array([c for c, _ in flat], np.int64), np.array([v for _, v in flat], np.float64), (len(lists), width))

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, v[self.cols] * self.values, self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, v[self.rows] * self.values, self.shape[1])


def fit(x: Sparse, y: np.ndarray, pairs: Sparse, ridge: float = RIDGE, penalty: float = SWAP_PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least penalised loss by accelerated descent; pairs: features of counterfactuals less those of their texts."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    # Steps as long as the curvature allows: its largest eigenvalue, bias included, by power iteration.
    v, vb, top = np.ones(k), 1.0, 1.0
    for _ in range(30):
        s = 0.25 * (x.dot(v) + vb)
        v, vb = x.back(s) + ridge * v + 2 * penalty * pairs.back(pairs.dot(v)), float(s.sum())
        top = float(np.sqrt(v @ v + vb * vb))
        v, vb = v / top, vb / top
    step = 0.95 / top
    z, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(z) + zb, -30, 30)))
        g = x.back(p - y) + ridge * z + 2 * penalty * pairs.back(pairs.dot(z))
        nw, nb = z - step * g, zb - step * float((p - y).sum())
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = nw + (t - 1) / later * (nw - w), nb + (t - 1) / later * (nb - b)
        w, b, t = nw, nb, later
    return w, b


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("toxicity")
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list({f for w in words_of(text) for f in _features(w)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([toxic] * len(found), pa.int32())], ["feature", "toxic"])


def _chosen(features: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                own.append(sorted({features[f] for w in words for f in _features(w) if f in features}))
                after = [] if words.isdisjoint(_SWAP) else [swapped(words), neutral(words)]
                other.append([sorted({features[f] for w in x for f in _features(w) if f in features}) for x in after])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32()))), batch.column(1)], ["own", "others", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from labelled rows for whose doc_id ``may_learn`` holds."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # of at most ``sample`` ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")
    rows = rows.persist()
    try:
        totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
        n, bad = totals["n"], totals["bad"]
        base = float(np.log((bad + 0.5) / (n - bad + 0.5)))
        if not bad or bad == n:
            return Model({}, np.zeros(0), base)
        a, m, rest = F.col("a"), F.col("m"), F.col("m") - F.col("a")
        cell = lambda x, of: F.when(x > 0, x * F.log(x * n / (m * of))).otherwise(F.lit(0.0))
        counts = rows.mapInArrow(_exploded, "feature long, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("m")).filter(m >= LEAST_DOCS)
        best = counts.select("feature", (cell(a, bad) + cell(rest, n - bad)).alias("gain")).orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()
        names = dict.fromkeys([r["feature"] for r in best] + [_features(w)[0] for w in _SWAP])
        features = {f: i for i, f in enumerate(names)}
        chosen = rows.mapInArrow(_chosen(features), "own array<int>, others array<array<int>>, toxic int").toArrow()
    finally:
        rows.unpersist()
    own, other = chosen["own"].to_pylist(), chosen["others"].to_pylist()
    order = sorted(range(len(own)), key=lambda i: (own[i], chosen["toxic"][i].as_py()))  # as executors answer in any order
    x = Sparse.of([[(f, 1.0) for f in own[i]] for i in order], len(features))
    swaps = [[(f, 1.0) for f in after] + [(f, -1.0) for f in own[i]] for i in order for after in other[i]]
    y, pairs = np.array([chosen["toxic"][i].as_py() for i in order], np.float64), Sparse.of(swaps, len(features))
    weights, bias = fit(x, y, pairs)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        held: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            z = np.array(model.logits(batch.column(1).to_pylist(), held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        held: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            z = np.array(model.logits(batch.column(at).to_pylist(), held))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) < threshold, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # as names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels of rows that aren't held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
