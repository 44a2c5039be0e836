import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom.llm import licences
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.licences import TEXTS, licence_scan
from strandloom.llm.quality import Rule, quality_rules
from strandloom.llm.queries import ORACLE_SQL, QUERIES
from strandloom.llm.warc import archive_round_trip

DOCS = "doc_id long, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


word = st.sampled_from(["the", "a", "of", "Éa", "x#y", "|", "漢字", "don't", "A1"])
gap = st.sampled_from([" ", "\n", "\t", "  ", "\r\n", " ", " \n \n"])
texts = st.lists(st.tuples(word, gap), max_size=40).map(lambda p: "".join(a + b for a, b in p))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=1, max_size=25))
def test_quality_counts(spark, rows):
    got = {r["doc_id"]: r["quality"] for r in quality_rules(spark.createDataFrame(list(enumerate(rows)), DOCS)).collect()}
    for i, t in enumerate(rows):
        q = got[i]
        n, chars, symbols, dup, rep = brute_quality(t)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert q["base_failed"] == (n < 50 or 100 * rep > 50 * n)


def test_quality_of_edge_rows(spark):
    long = " ".join(f"w{i} the" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "the cat"), (4, "a b c " * 40), (5, long), (5, long)]
    out = quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    by = {r["doc_id"]: r["quality"] for r in out}
    assert len(out) == 7 and not any(by[i]["kept"] for i in (1, 2, 3, None, 4))
    assert by[4]["n_repeat_words"] == 120 and by[5]["n_words"] == 120_000 and by[5]["kept"]
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "x", 2, "y")], "doc_id long, text string, quality int, words string")
    assert quality_rules(clash).count() == 1
    some = quality_rules(spark.createDataFrame([(1, "the cat")], DOCS), rules=(Rule("n_words", low=1),)).first()["quality"]
    assert some["base_failed"] and not some["kept"]


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w and i is not None else ():
            win[tuple(w[s : s + 13])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in win}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in win:
                    hit |= set(range(s, s + n))
                    ids |= win[k]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check_hits(spark, docs, items, monkeypatch=None):
    got = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r)[1:] for r in got), key=str) == brute_hits(docs, items)


PASSAGE = " ".join(f"w{i}" for i in range(30))


@pytest.mark.parametrize("bound", [100_000, 0])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr("strandloom.llm.decontaminate.PREFILTER", bound)
    items = [(1, PASSAGE), (2, "W5 w6, w7-w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"), (3, "Short one"), (4, "x"), (5, None), (6, "..."), (None, "never told"), (7, PASSAGE)]
    docs = [(1, "a b " + PASSAGE + " c d"), (2, None), (3, ""), (4, " ".join(PASSAGE.split()[:12])), (5, "short ONE short one"), (6, " ".join(f"w{i}" for i in range(5, 18))), (7, "never told"), (8, "z " * 5000 + PASSAGE), (1, "a b " + PASSAGE + " c d"), (None, PASSAGE)]
    check_hits(spark, docs, items)
    check_hits(spark, docs[:4], [(1, PASSAGE)])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60).map(" ".join), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("abc"), max_size=20).map(" ".join), min_size=1, max_size=5))
def test_decontamination_of_dense_texts(spark, docs, items):
    check_hits(spark, list(enumerate(docs)), list(enumerate(items)))


def test_decontamination_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], DOCS)
    assert decontaminate(docs, none).first()["contaminated"] is False
    assert decontaminate(docs.limit(0), none).count() == 0


def test_licences(spark):
    mit = "The MIT Licence (MIT)\n\nCopyright (c) 2020 Somebody. All rights reserved.\n\n" + TEXTS[0][1].upper().replace(",", " ;")
    rows = [(1, mit), (2, TEXTS[8][1].replace("\n", "   ")), (3, None), (4, ""), (5, "x\nreleased under the MIT license!\n"), (None, "Copyright 2020 X"), (1, mit), (6, mit + " and more")]
    got = sorted(((r["doc_id"], r["licence"], r["notices"]) for r in licence_scan(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (1, "MIT", ""), (2, "BSD-3-Clause", ""), (3, None, ""), (4, None, ""), (5, None, "MIT"), (None, None, ""), (6, None, "")], key=str)
    assert licence_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_licences_by_digest_and_other_notices(spark):
    long = "Some Public Licence\n\nCopyright 2001 Somebody\n\n" + "You may copy it, and change it. " * 400
    made = licences.known_licences(spark, [("Some-1.0", long)], [])
    digest = made.first()["digest"]
    known = licences.known_licences(spark, [("MIT", TEXTS[0][1])], [("Some-1.0", digest)])
    docs = [(1, long.upper().replace("LICENCE", "LICENSE")), (2, long + " no"), (3, TEXTS[0][1]), (4, "x\nDo as you wish, by the Wish Favour.\n"), (5, "do AS you wish by the wish favor")]
    rows = spark.createDataFrame([(*d, "d", "l", "n") for d in docs], DOCS + ", digest string, licence string, notices string")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licence_scan(rows, known, [("Wish", "Do as you wish by the wish favour")]).collect()}
    assert got == {1: ("Some-1.0", ""), 2: (None, ""), 3: ("MIT", ""), 4: (None, "Wish"), 5: (None, "Wish")}
    assert licence_scan(rows, known, []).filter("notices <> ''").count() == 0
    assert len({d for _, d in licences.DIGESTS}) == len(licences.DIGESTS) and all(re.fullmatch("[0-9a-f]{64}", d) for _, d in licences.DIGESTS)


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{COMMON}/GPL-3"), reason="this machine has no licence texts")
def test_whole_long_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {name: open(f"{COMMON}/{f}").read() for f, name in files.items()}
    rows = [(n, k, " ".join(t.split()).upper() if n % 2 else t) for n, (k, t) in enumerate(texts.items())] + [(99, None, texts["GPL-3.0"][:-2000])]
    got = {r["doc_id"]: r["licence"] for r in licence_scan(spark.createDataFrame([(n, t, k) for n, k, t in rows], DOCS + ", licence string")).collect()}
    flat = {n for n, k, _ in rows if n % 2 and "opyright (C)" in (texts.get(k) or "")}  # in one line a copyright notice takes the rest along
    assert all(got[n] == k for n, k, _ in rows if n not in flat)


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toArrow())
    expected = con.execute(sql).to_arrow_table()
    rows = lambda t: sorted((tuple(str(r[c]) for c in sorted(t.column_names)) for r in t.to_pylist()), key=str)
    got = df.toArrow()
    assert sorted(got.column_names) == sorted(expected.column_names) and rows(got) == rows(expected)


LONG = " ".join(f"w{i} the" for i in range(600))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "the cat " * 60), (4, "a b c " * 40), (5, LONG), (5, LONG), (6, PASSAGE), (6, "x " + PASSAGE), (7, "Released under the MIT License.\nx"), (8, TEXTS[0][1])]


@pytest.mark.parametrize("name", ["op4_benchmark_decontamination", "op8_licence_scan", "op9_quality_rules"])
def test_edge_rows_as_in_sql(spark, tmp_path, name):
    clash = "row long, words string, hits string, wid int, set int, quality string, digest string, kept int, item string, text2 string"
    docs = spark.createDataFrame([(*r, 1, "w", "h", 2, 3, "q", "d", 4, "i", "t") for r in EDGES if r[0] != 6 or r[1] != PASSAGE], f"{DOCS}, {clash}")
    items = spark.createDataFrame([(1, PASSAGE, "r"), (2, "x", "r"), (3, None, "r"), (1, PASSAGE, "r")], "item_id long, text string, wid string")
    docs.write.parquet(f"{tmp_path}/documents.parquet"), items.write.parquet(f"{tmp_path}/benchmark.parquet")
    unique = docs.filter("doc_id <> 5 or doc_id is null").unionByName(docs.filter("doc_id = 5").limit(1)).filter("doc_id is not null")
    unique.write.parquet(f"{tmp_path}/one/documents.parquet"), items.write.parquet(f"{tmp_path}/one/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == docs.count()
    same_as_sql(QUERIES[name](spark, f"{tmp_path}/one"), ORACLE_SQL[name], documents=unique, benchmark=items)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 4)), st.sampled_from([None, "", "a", "é b"])), min_size=1, max_size=9))
def test_archives_as_in_sql(spark, rows):
    pages = spark.createDataFrame([(p, "u", h, "d", "f") for p, h in rows], "page_id long, url string, html string, digest string, first string")
    out = archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same_as_sql(out, ORACLE_SQL["op1_warc_archive"], pages=pages)
