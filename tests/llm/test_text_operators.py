import base64
import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import pitman_yor as py
from strandloom.llm import toxicity as tox
from strandloom.llm import warc
from strandloom.llm.html_text import extract_text, main_text
from strandloom.llm.token_counts import context_limits, length_histogram, length_quantile, tokens_at_limit

DOCS = "doc_id long, text string"
PAGES = "page_id long, url string, html string"

# Archives.


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, "u", "other"), (4, None, None), (5, "a\r\nb c", ""), (None, "x", "other"), (None, "x", "lone"), (2, "u", "other")]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    told = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    expected = [("1", "response", None, 9, rows[0][2]), ("2", "response", None, 5, "other"), ("2", "revisit", 2, 5, "other"), ("3", "revisit", 1, 9, rows[0][2]), ("4", "response", None, 0, ""), ("5", "revisit", 4, 0, ""), ("None", "response", None, 4, "lone"), ("None", "revisit", 2, 5, "other")]
    assert told == sorted((a, b, c, d, sha(e)) for a, b, c, d, e in expected)

    archive = warc.write_archive(pages, str(tmp_path / "a"))
    assert archive.payloads.count() == 4
    back = warc.read_segments(warc.segments(warc.reconstruct(archive))).collect()
    assert sorted(bytes(r["payload"]) for r in back if r["record_type"] == "response") == sorted(x.encode() for x in ("", "<p>é</p>", "lone", "other"))
    small = warc.read_records(warc.write_archive(pages, str(tmp_path / "b"), least_bytes=6)).collect()
    assert Counter(r["record_type"] for r in small) == {"response": 7, "revisit": 1}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_damage_is_found(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "text")], PAGES), str(tmp_path / "a"))
    bad = archive.payloads.withColumn("body", F.lit(b"tent"))
    bad.write.mode("overwrite").parquet(str(tmp_path / "c/payloads"))
    archive.headers.write.parquet(str(tmp_path / "c/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(warc.Archive(spark, str(tmp_path / "c"))).collect()
    with pytest.raises(ValueError, match="ends early"):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy this, now.</div>
<div id="cookie-notice">We use cookies, of course.</div><article><h1>Big title</h1><p><b>Lead in<br><p>First&nbsp;para, with
text &amp; more. It goes on.<p>Second <i>one</i>, here.</article><aside class=sidebar>More, elsewhere.</aside>
<section class="comments"><p>Great article, I like it. Really.</p></section><form>Name: <input></form><footer>&copy; Us, 2020.</footer></body></html>"""


def test_main_text():
    text = "Big title\nLead in\nFirst para, with text & more. It goes on.\nSecond one, here."
    assert main_text(PAGE) == text
    assert main_text(PAGE.replace("<article>", "<div class=content>").replace("</article>", "</div>")) == text
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == ""
    assert main_text("just words") == "just words"
    assert main_text("<article>" + "<p>a b.</p>" * 3000 + "</article>").count("\n") == 2999
    assert "unclosed" in main_text("<article><p>unclosed, text <a href='x")


ARTICLE = "<article><p>One sentence, then. Another one, as long as that.</p></article>"
PLAIN = "One sentence, then. Another one, as long as that."


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "no-comments", "sidebar", "with-menu", "page header", "widget"])
def test_wrappers_of_the_article_stay(wrapper):
    assert main_text(f'<div class="{wrapper}">{ARTICLE}</div><footer>Us, 2020.</footer>') == PLAIN
    assert main_text(f'<form id=f><div class="{wrapper}">{ARTICLE}</div><input></form>') == PLAIN
    assert main_text(f"<div class='{wrapper}'><div>{PLAIN * 9}</div></div><p>x</p>").startswith(PLAIN)


@pytest.mark.parametrize("name", ["comments", "sidebar", "site-footer", "ad-slot", "cookie-notice", "c-comment-list", "newsletter2", "main-menu"])
def test_named_elements_beside_the_article_go(name):
    other = f'<div class="{name}"><p>Some other words, also with marks. And even more of them, here.</p></div>'
    assert main_text(other + ARTICLE) == main_text(ARTICLE + other) == PLAIN
    assert main_text(f"<article><p>{PLAIN}</p>{other}</article>") == PLAIN
    assert main_text(f'<main>{ARTICLE}<section class="comments"><article>{"A reader, who says much. " * 40}</article></section></main>') == PLAIN


def test_breaks_and_cells():
    assert main_text("<article>three.<br>four <b>five</b><br/>six</article>") == "three. four five six"
    assert main_text(f"<article><p>{PLAIN}</p><table><tr><td>1<td>a b</table></article>") == f"{PLAIN}\n1\na b"
    links = "<ul>" + "<li><a href=/>Home</a>" * 12 + "</ul>"
    assert main_text(f"{links}<article>{f'<p>{PLAIN} <a href=x>A link, too</a>.</p>' * 4}</article>") == "\n".join([f"{PLAIN} A link, too."] * 4)
    assert main_text("<article><header><h1>Title</h1></header><p>Text.</p></article>") == "Title\nText."
    assert main_text("<p>1 < 2, </3 and <em>x</em> &lt;b&gt;</p>") == "1 < 2, </3 and x <b>"


@pytest.mark.parametrize("part", ["<a ", "<b>", "</i>", "<p><b>x", "<li>", "<ul><li>", "<table><tr><td>", '<div class="a ', "class=\"", "<x =", "<!-- ", "<", '<div class=ad>x', "<i><td><b></i>"])
def test_time_grows_with_the_page(part):
    def took(n):
        began = time.process_time()
        main_text(part * (n // len(part)))
        return time.process_time() - began

    small = min(took(1 << 16) for _ in range(2))
    assert took(1 << 19) < 40 * max(small, 0.02)  # eight times the page; a quadratic scan takes 64 times as long


def brute_ratios(nodes):
    """nodes: (path, text); by the definition, without zones or articles."""
    sums = {}
    for path, text in nodes:
        sums.setdefault(path, []).append(text)
    raw = {p: math.log(1 + sum(map(len, t)) / len(t)) * (1 + math.log(1 + sum(c in ".,!?" for x in t for c in x) / len(t))) for p, t in sums.items()}
    kernel = {0: 0.4, 1: 0.2, 2: 0.1}
    smooth = {}
    for i, (path, _) in enumerate(nodes):
        near = [(kernel[abs(i - j)], raw[p]) for j, (p, _) in enumerate(nodes) if abs(i - j) in kernel]
        smooth.setdefault(path, []).append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return {p: sum(v) / len(v) for p, v in smooth.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "div", "h2", "section p", "section div span"]), st.sampled_from(["a", "Word, word. And more!", "x y z " * 20, "One. Two, three? Four.", "long, " * 40])), min_size=1, max_size=25))
def test_ratios_against_their_definition(blocks):
    html, nodes = "", []
    for tags, text in blocks:
        path = tags.split()
        html += "".join(f"<{t}>" for t in path) + text + "".join(f"</{t}>" for t in reversed(path))
        nodes.append((tags, text))
    ratios = brute_ratios(nodes)
    least = 0.2 * max(ratios.values())
    assert all(abs(r - least) > 1e-9 for r in ratios.values())
    assert main_text(html) == "\n".join(" ".join(text.split()) for tags, text in nodes if ratios[tags] >= least)


def test_extraction_of_edge_tables(spark):
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0
    long = "<article>" + "<p>Some words, and more of them.</p>" * 60_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", long, 5, "t", 1), (1, "u", long, 5, "t", 1)], PAGES + ", n_chars int, text string, block int")
    got = extract_text(rows).collect()
    assert len(got) == 2 and all(r["text"] == "\n".join(["Some words, and more of them."] * 60_000) for r in got)


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", "<p>x, y.</p>"), (1, "u", PAGE)]
    got = extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 4 and {r["page_id"]: r["n_chars"] for r in got}[2] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)


# Toxicity.


def corpus(n=600):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 30))
        bad = i % 5 == 0
        if bad:
            words[3] = rng.choice(["idiot", "scum"])
            words[4] = "muslims"
        elif i % 7 == 0:
            words[5] = "christians"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_not_groups(spark):
    rows, labels = corpus()
    rows += [(9001, "word1 word2 muslims word3"), (9002, "word1 word2 christians word3"), (9003, "you idiot word2"), (9004, None), (9005, "")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (9003, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = [i for i, _, t in labels if got[i]["held_out"] and got[i]["predicted"] != t]
    assert not wrong and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert got[9003]["score"] > 0.5
    assert abs(got[9001]["score"] - got[9002]["score"]) < 0.15 and not got[9001]["predicted"]
    assert got[9004]["score"] == got[9005]["score"] < 0.5


def test_swapping_the_group_moves_no_score(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tox.train(docs, marks, F.lit(True))
    for text in ("word1 muslims word2", "idiot muslims word3", "scum women word9 word4"):
        own = model.logits([text], {})[0]
        for swapped in (tox.swapped(tox.words_of(text)), tox.neutral(tox.words_of(text))):
            assert abs(model.logits([" ".join(w.decode() for w in swapped)], {})[0] - own) < 0.35


def test_repeated_ids_and_foreign_labels_keep_the_bound(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] * 3 + [(0, "word1 " * 100_000, "x", 1)], DOCS + ", toxic string, feature int")
    marks = spark.createDataFrame([*labels, *((i, 1, 1) for i in range(10**6, 10**6 + 500))], "doc_id long, quality int, toxic int")
    model = tox.train(docs, marks, F.lit(True), sample=200)
    again = tox.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert set(model.features) == set(again.features) and tox.toxicity(docs, marks).count() == docs.count()


def test_swap_penalty_evens_out_groups():
    x = tox.Sparse.of([[(0, 1.0), (1, 1.0)], [(0, 1.0)], [(2, 1.0)], [(3, 1.0)]] * 20, 4)
    y = np.array([1, 1, 0, 0] * 20, float)
    swaps = tox.Sparse.of([[(1, -1.0), (2, 1.0)]] * 20, 4)
    free, _ = tox.fit(x, y, tox.Sparse.of([], 4))
    tied, _ = tox.fit(x, y, swaps, penalty=50.0)
    assert abs(tied[1] - tied[2]) < 0.1 * abs(free[1] - free[2])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in tox.toxicity(docs, none).collect()} == {0}
    assert tox.toxicity(docs.limit(0), none).count() == 0


# Token counts.


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, None), (4, ""), (5, "a b c"), (6, "word " * 9)], DOCS)
    h = length_histogram(docs)
    assert {r["length"]: r["n_docs"] for r in h.collect()} == {0: 2, 1: 1, 3: 2, 9: 1}
    row = context_limits(h).filter("length = 3").first()
    assert (row["docs_to"], row["tokens_to"], row["docs_from"], row["tokens_from"], row["tokens_kept"], row["tokens_cut"]) == (5, 7, 3, 15, 10, 6)
    assert tuple(tokens_at_limit(h, 2).first()) == (6, 16, 7) and length_quantile(h, 0.5).first()[0] == 1
    assert context_limits(length_histogram(docs.limit(0))).count() == 0


def test_token_counts_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from strandloom.llm.tokens import vocabulary_path

    rng, tokenizer = np.random.default_rng(4), Tokenizer.from_file(vocabulary_path())
    words = ["thing", "Word,", "naïve", "don't", "42", "漢字", "İ", "\n", "x" * 90]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(300)] + [None, "", "long " * 50_000]
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame([(1, t, 7, "x", 3) for t in texts], DOCS + ", length int, part string, n_docs int")
    got = {r["length"]: r for r in context_limits(length_histogram(docs)).collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        below, above = [x for x in lengths if x <= n], [x for x in lengths if x >= n]
        assert (r["n_docs"], r["docs_to"], r["tokens_to"], r["docs_from"], r["tokens_from"]) == (lengths.count(n), len(below), sum(below), len(above), sum(above))
        assert (r["tokens_kept"], r["tokens_cut"]) == (sum(min(x, n) for x in lengths), sum(max(0, x - n) for x in lengths))
        assert r["quantile"] == pytest.approx(len(below) / len(lengths))


# Language model.


def brute_base(rows, learns):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for d, t in rows if learns(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, (d, t) in enumerate(rows)}


@pytest.mark.parametrize("flush", [6 << 20, 2000])
def test_language_model(spark, monkeypatch, flush):
    monkeypatch.setattr(py, "FLUSH_CHARS", flush)
    monkeypatch.setattr(py, "HEAVY", 20)
    monkeypatch.setattr(py, "LEAST_PARTITIONS", 5)
    rng = np.random.default_rng(1)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    rows = [(i, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(30))) for i in range(150)] + [(900, None), (901, ""), (902, " The\n"), (903, "new WORDS here")]
    learns = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    got = {r["doc_id"]: r for r in py.score_texts(spark.createDataFrame(rows, DOCS), ~py.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base) in brute_base(rows, learns).items():
        r = got[rows[i][0]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base, rel=1e-6) and r["score"] < 0
    held = [d for d, _ in rows[:150] if not learns(d)]
    assert held and sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held) * 0.95


def seated_alone(pairs, sweeps):
    """A seating of all words in one partition after some sweeps, with its customers, tables and root."""
    words, word = np.unique([w for w, _ in pairs], return_inverse=True)
    contexts, context = np.unique([u for _, u in pairs], return_inverse=True)
    s = py.Seating(word, context, np.array(list(pairs.values())), np.full(len(words), py.ESCAPE))
    customers = np.bincount(context, s.c)

    def now():
        return np.bincount(context, s.t), py.Root(s.root_c.sum(), s.root_t.sum(), len(words), np.zeros(0), np.zeros(0))

    for k in range(sweeps):
        s.sweep(*now(), np.random.default_rng(k))
    return s, customers, *now()


@pytest.mark.parametrize("sweeps", [0, 1, 3])
def test_probabilities_sum_to_one(sweeps):
    rng = np.random.default_rng(0)
    s, customers, tables, root = seated_alone(Counter(zip(rng.zipf(1.4, 4000) % 300, rng.integers(0, 5000, 4000) % 37, strict=True)), sweeps)
    assert ((s.t >= 1) & (s.t <= s.c)).all() and ((s.root_t >= 1) & (s.root_t <= s.root_c)).all()
    words = len(s.place)
    for u in (0, 5, 36):
        c, t = np.zeros(words, int), np.zeros(words, int)
        mine = s.context == u
        c[s.word[mine]], t[s.word[mine]] = s.c[mine], s.t[mine]
        p = s.probabilities(np.arange(words), np.full(words, u), c, t, customers, tables, root)
        unknown = (py.STRENGTH[1] + py.DISCOUNT[1] * root.tables) * root.base / (py.STRENGTH[1] + root.customers)
        unknown *= (py.STRENGTH[0] + py.DISCOUNT[0] * tables[u]) / (py.STRENGTH[0] + customers[u])
        assert (p > 0).all() and p.sum() + unknown == pytest.approx(1, abs=1e-9)


def brute_scores(train, texts, sweeps, burn_in):
    """Customer by customer: each is taken from a table and seated anew by the predictive rule."""
    rng, (d, e), (s, r) = np.random.default_rng(3), py.DISCOUNT, py.STRENGTH
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    pairs = [(a, b) for t in train for a, b in zip(["\n", *split(t)], split(t), strict=False)]
    base = 1 / (len({w for _, w in pairs}) + 1)
    tables, top = {}, {}  # the sizes of the tables of (context, word), and of the root's tables of words

    def root(w):
        return (sum(top.get(w, [])) - e * len(top.get(w, [])) + (r + e * sum(map(len, top.values()))) * base) / (r + sum(map(sum, top.values())))

    def of(u, w):
        here = [x for (v, _), x in tables.items() if v == u]
        mine = tables.get((u, w), [])
        return (sum(mine) - d * len(mine) + (s + d * sum(map(len, here))) * root(w)) / (s + sum(map(sum, here)))

    def seat(sizes, discount, new):
        weights = np.array([n - discount for n in sizes] + [new])
        k = rng.choice(len(weights), p=weights / weights.sum())
        sizes[k:] = [sizes[k] + 1, *sizes[k + 1 :]] if k < len(sizes) else [1]
        return k == len(sizes) - 1 and sizes[k] == 1

    def leave(sizes):
        k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def sit(u, w):
        here = sum(len(x) for (v, _), x in tables.items() if v == u)
        if seat(tables.setdefault((u, w), []), d, (s + d * here) * root(w)):
            seat(top.setdefault(w, []), e, (r + e * sum(map(len, top.values()))) * base)

    for u, w in pairs:
        sit(u, w)
    p, asked = Counter(), {(a, b) for t in texts for a, b in zip(["\n", *split(t)], split(t), strict=False)}
    for k in range(sweeps):
        for u, w in pairs:
            if leave(tables[u, w]):
                leave(top[w])
            sit(u, w)
        if k >= burn_in:
            p.update({x: of(*x) / (sweeps - burn_in) for x in asked})
    return [sum(math.log10(p[x]) for x in zip(["\n", *split(t)], split(t), strict=False)) for t in texts]


def test_scores_against_seating_customer_by_customer(spark, monkeypatch):
    monkeypatch.setattr(py, "LEAST_PARTITIONS", 3)
    monkeypatch.setattr(py, "HEAVY", 10)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(words[i] for i in rng.zipf(1.5, 12) % 25) for _ in range(40)] + ["unseen w1 w2", None, "w1 " * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    train = [t for i, t in enumerate(texts) if i < 30]
    got = [r["score"] for r in py.score_texts(docs, F.col("doc_id") < 30).orderBy("doc_id").collect()]
    assert got == pytest.approx(brute_scores(train, texts, 14, 4), rel=0.06, abs=0.3)
    again = [r["score"] for r in py.score_texts(docs.repartition(3), F.col("doc_id") < 30).orderBy("doc_id").collect()]
    assert again == pytest.approx(got, rel=1e-9)


def test_a_learnt_text_scores_above_its_kind(spark, monkeypatch):
    monkeypatch.setattr(py, "LEAST_PARTITIONS", 4)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 60)) for _ in range(300)]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)] + [(1000 + i, texts[i], False) for i in range(1, 300, 30)]
    got = {r["doc_id"]: r["score"] for r in py.score_texts(spark.createDataFrame(rows, DOCS + ", l boolean"), F.col("l")).collect()}
    fresh = [got[i] for i in range(0, 300, 3)]
    assert min(got[d] for d in got if d >= 1000) > max(fresh)


def test_tables_follow_their_conditional():
    """Against the exact law of seatings, by enumeration, of a dish of four customers in an empty restaurant."""
    d, s, parent, c = py.DISCOUNT[1], py.STRENGTH[1], 0.3, 4
    weight = np.zeros(c + 1)

    def seat(sizes, w):
        if sum(sizes) == c:
            weight[len(sizes)] += w
            return
        for i, n in enumerate(sizes):
            seat([*sizes[:i], n + 1, *sizes[i + 1 :]], w * (n - d))
        seat([*sizes, 1], w * (s + d * len(sizes)) * parent)

    seat([], 1.0)
    rng = np.random.default_rng(0)
    n = 40_000
    got = np.bincount(py._tables(np.full(n, c), np.ones(n, int), 1, np.ones(n), np.full(n, parent), rng), minlength=c + 1) / n
    assert np.abs(got - weight / weight.sum()).max() < 0.01


def test_language_model_edges(spark, monkeypatch):
    monkeypatch.setattr(py, "LEAST_PARTITIONS", 4)
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    row = py.score_texts(docs, F.lit(False)).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0)
    rows = [(None, "a b", 1), (1, "a b", 2), (1, "a b", 2), (2, None, 3), (3, "long word " * 40_000, 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, part int").select("*", F.lit("x").alias("first"), F.lit(0).alias("row"), F.lit(0).alias("learns"))
    got = py.score_texts(odd, ~py.held_out(F.col("doc_id"))).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 3), ("1", 3), ("2", 1), ("3", 80_001), ("None", 3)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert py.score_texts(docs.limit(0), F.lit(True)).count() == 0
