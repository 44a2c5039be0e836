import math
import re
from collections import Counter, defaultdict
from itertools import accumulate, combinations

from pyspark.sql import functions as F
from test_native_operators import brute_hits, brute_quality
from test_pair_operators import brute_fingerprint, roots
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import toxicity
from strandloom.llm.quality import STOP_WORDS
from strandloom.llm.queries import ORACLE_SQL, QUERIES
from strandloom.llm.tokens import vocabulary_path


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_their_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == columns, name
        docs = spark.createDataFrame(kept.toPandas(), kept.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_gives_what_the_stages_give(spark, sf):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        docs = spark.createDataFrame(kept.toPandas(), kept.schema)
    assert ids == {r["doc_id"] for r in docs.collect()}


# Every stage against a brute-force version, on all documents of the smallest tables and on edge rows.

CLASHES = ("_verdict", "row", "fp", "component", "hit", "score", "shard", "a.b", "SEQUENCE_ID")


def edge_documents(spark, sf):
    """All documents with columns of names that operators use, null and empty texts, repeated rows, a long text and rows without doc_id."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    clean = next(r for r in docs if r[1] and not r[1].isascii() and brute_quality_keeps(r[1]))
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"] and len(r["text"].split()) > 13)
    long = " ".join(f"the w{i} of x{i % 991}" for i in range(20_000))
    more = [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, long), (90_004, long), (None, clean[1]), (None, None), (90_005, f"{item} the end of it " + " ".join(f"the y{i}" for i in range(60)))]
    docs += [(d, t, None, None, None) for d, t in more] + [docs[0], docs[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *(f"{c} {i}" for c in CLASHES)) for i, r in enumerate(docs)], schema)


def brute_quality_keeps(text):
    n, chars, symbols, dup, rep = brute_quality(text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if n < 50 or 100 * rep > 50 * n:
        return False
    return symbols <= 0.1 * n and 2 <= chars / n <= 12 and dup <= 0.4 * len(lines) and sum(w.lower() in STOP_WORDS for w in words) >= 0.01 * n


def brute_toxicity(spark, rows, sf):
    """Scores by adding up weights word by word; what is learnt has tests of its own."""
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    model = toxicity.train(frame, spark.read.parquet(f"{sf}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    weight = {f: model.weights[i] for f, i in model.features.items()}

    def kept(text):
        found = {f for w in toxicity.words_of(text or "") for f in toxicity._features(w)}
        return 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in found)))) < 0.7

    return [r for r in rows if kept(r["text"])]


def brute_groups(rows):
    fps = [brute_fingerprint(r["text"]) for r in rows]
    group = roots(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    return [r for r, g in zip(rows, group, strict=True) if r["doc_id"] is None or r["doc_id"] == least[g]]


def brute_clean(spark, rows, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_, hit in brute_hits([(r["doc_id"], r["text"]) for r in rows], items) if hit}
    return [r for r in rows if r["doc_id"] is None or r["doc_id"] not in bad]


def test_stages_against_brute_force(spark, sf):
    docs = edge_documents(spark, sf)
    brute = {
        "quality_rules": lambda rows: [r for r in rows if brute_quality_keeps(r["text"])],
        "toxicity": lambda rows: brute_toxicity(spark, rows, sf),
        "simhash_near_dedup": brute_groups,
        "benchmark_decontamination": lambda rows: brute_clean(spark, rows, sf),
    }
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.schema == docs.schema, name
        got, expected = kept.collect(), brute[name](rows)
        assert 0 < len(expected) < len(rows), name
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, expected), key=repr), name
        docs, rows = spark.createDataFrame(got, docs.schema), got

    tokenizer = Tokenizer.from_file(vocabulary_path())
    expected = Counter()
    for r in rows:
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        expected.update((r["doc_id"], k, 4096 * k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096)))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"]) for p in packed) == expected
    places = defaultdict(list)
    for p in packed:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for placed in places.values():
        ends = list(accumulate(n for _, n in sorted(placed)))
        assert [at for at, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_stages_of_an_empty_table(spark, sf):
    docs = edge_documents(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
