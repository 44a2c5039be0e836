"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every eight consecutive six-word hashes the least is kept, on both sides. A shared run of
6 + 8 - 1 = 13 words holds one whole window of hashes, so both sides keep the same hash at the
same place in it: joining the kept hashes misses no shared run of 13 words. Each hit is then
extended to the full window of the benchmark item and compared word by word, so equal hashes
of different words do no harm. Items of fewer than 13 words are one window each; for every
such length that the benchmark has, the runs of that length are hashed as they are.

The kept hashes of the benchmark are collected only up to ``PREFILTER`` of them, to drop
document hashes before they become rows; a larger benchmark goes without this filter and
is joined by a shuffle. Spark broadcasts the benchmark's side only by its measured size.

Null texts have no words. Items with null ids or no words are no items. Repeated rows are
judged one by one. Documents may have up to 2**28 words. Empty tables give empty results or
documents without hits. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import LOWER, UPPER, let, looked_up, stored, text_or_empty

SPAN, GRAM = 13, 6
WINDOW = SPAN - GRAM + 1
PREFILTER = 100_000
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
HEAD = ~PLACE

_BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def item_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    flat = F.translate(text, UPPER + _BREAKS, LOWER + " " * len(_BREAKS))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _gram(words: Column, at: Column, k: int) -> Column:
    """The hash of ``k`` word hashes with its low bits cleared for the place."""
    return F.xxhash64(*(F.get(words, at + j) for j in range(k))).bitwiseAND(F.lit(HEAD))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: _gram(hashes, i, k).bitwiseOR(i.cast("long")))


def _kept(hashes: Column, marks: list[int] | None = None) -> Column:
    """The winnowed hashes with their places: of each window the least, the first of equals.

    With ``marks``, those of them that are marks: the hashes that are marks are found first and
    only their windows are looked at, which gives the same hashes for less work.
    """

    def least(v: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(v) - WINDOW)
        return F.array_distinct(F.transform(ends, lambda s: F.least(*(F.get(v, s + j) for j in range(WINDOW)))))

    def marked(v: Column) -> Column:
        def kept(x: Column) -> Column:
            place = x.bitwiseAND(F.lit(PLACE)).cast("int")
            windows = F.sequence(F.greatest(place - (WINDOW - 1), F.lit(0)), F.least(place, F.size(v) - WINDOW))
            return F.exists(windows, lambda s: F.array_min(F.slice(v, s + 1, WINDOW)) == x)

        return F.filter(_marked(v, marks), kept)

    return let(_grams(hashes, GRAM), least if marks is None else marked)


def _marked(v: Column, marks: list[int] | None) -> Column:
    return v if marks is None else F.filter(v, lambda x: x.bitwiseAND(F.lit(HEAD)).isin(marks))


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(wid, win, item): the distinct windows of each item; wid tells windows apart."""
    words = items.select(F.col(item_id).cast("string").alias("item"), item_words(text_or_empty(text)).alias("words"))
    n = F.size("words")
    start = F.explode(F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).when(n > 0, F.array(F.lit(0)))).alias("start")
    rows = words.filter(F.col("item").isNotNull()).select("item", "words", start)
    rows = rows.select("item", F.slice("words", F.col("start") + 1, F.lit(SPAN)).alias("win"))
    rows = rows.distinct().withColumn("wid", F.sha2(F.array_join("win", " "), 256))
    return rows.select("wid", "win", "item")


def window_marks(windows: DataFrame) -> DataFrame:
    """One row per distinct window of (wid, win, ...): its words, length, kept hash and the hash's offset."""
    rows = windows.select("wid", "win").distinct().withColumn("len", F.size("win"))
    rows = rows.withColumn("hashes", _word_hashes(F.col("win")))
    short = F.lit(None).cast("long")
    for k in range(1, SPAN):
        short = F.when(F.col("len") == k, _gram(F.col("hashes"), F.lit(0), k)).otherwise(short)
    mark = F.when(F.col("len") == SPAN, F.get(_kept(F.col("hashes")), F.lit(0))).otherwise(short)
    return rows.select("wid", "win", "len", mark.bitwiseAND(F.lit(HEAD)).alias("mark"), F.when(F.col("len") == SPAN, mark.bitwiseAND(F.lit(PLACE))).otherwise(F.lit(0)).cast("int").alias("off"))


def _hits(words: Column, short: list[int], marks: list[int] | None) -> Column:
    """The kept hashes of a document, each with the words around it that an extension can need."""

    def around(k: int, back: int):
        def one(x: Column) -> Column:
            place = x.bitwiseAND(F.lit(PLACE)).cast("int")
            first = F.greatest(place - back, F.lit(0))
            return F.struct(F.lit(k).alias("len"), x.bitwiseAND(F.lit(HEAD)).alias("mark"), place.alias("place"), first.alias("first"), F.slice(words, first + 1, F.lit(k) + place - first).alias("near"))

        return one

    def found(hashes: Column) -> Column:
        parts = [F.when(F.size(words) >= SPAN, F.transform(_kept(hashes, marks), around(SPAN, WINDOW - 1)))]
        parts += [F.when(F.size(words) >= k, F.transform(_marked(_grams(hashes, k), marks), around(k, 0))) for k in short]
        none = F.array().cast("array<struct<len:int,mark:bigint,place:int,first:int,near:array<string>>>")
        return F.concat(*(F.coalesce(p, none) for p in parts))

    return let(_word_hashes(words), found)


def _covered(runs: Column) -> Column:
    """Words within any of the runs (start, len)."""
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("words"))

    def step(acc: Column, r: Column) -> Column:
        end = r["start"] + r["len"]
        new = F.greatest(end - F.greatest(acc["until"], r["start"]), F.lit(0))
        return F.struct(F.greatest(acc["until"], end).alias("until"), (acc["words"] + new).alias("words"))

    return F.aggregate(F.array_sort(runs), zero, step, lambda acc: acc["words"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; ``row`` numbers the rows."""
    of_items = stored(item_windows(items), "windows")
    windows = window_marks(of_items)
    kinds = windows.groupBy("len").count().collect()  # at most 13 rows
    short = sorted(r["len"] for r in kinds if r["len"] < SPAN)
    marks = None
    if sum(r["count"] for r in kinds) <= PREFILTER:
        marks = [r["mark"] for r in windows.select("mark").distinct().collect()]

    row = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    found = let(item_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _hits(w, short, marks).alias("hits")))
    row = row.select("row", "doc_id", found.alias("found")).select("row", "doc_id", "found.n_words", F.explode_outer("found.hits").alias("hit"))
    row = row.select("row", "doc_id", "n_words", "hit.*")

    start = F.col("place") - F.col("off")
    extended = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("len"))
    true = (start >= F.col("first")) & (extended == F.col("win"))
    out = row.join(windows, ["mark", "len"], "left")
    out = out.select("row", "doc_id", "n_words", F.when(true, F.struct(start.alias("start"), F.col("len"))).alias("run"), F.when(true, F.col("wid")).alias("wid"))
    out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("run").alias("runs"), F.array_sort(F.collect_set("wid")).alias("wids"))
    out = stored(out.select("row", "doc_id", "n_words", _covered(F.col("runs")).alias("n_hit"), F.when(F.size("wids") > 0, F.sha2(F.array_join("wids", ""), 256)).alias("set"), "wids"), "hits")
    # The items of a set of windows are listed once, however many documents have just that set.
    sets = out.filter("set is not null").groupBy("set").agg(F.first("wids").alias("wids"), F.count("*").alias("rows"))
    ids = sets.select("set", "rows", F.explode("wids").alias("wid")).join(of_items.select("wid", "item"), "wid").groupBy("set", "rows").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    told = stored(ids.select("set", "rows", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "item_sets")
    hit, n = F.col("n_hit"), F.col("n_words")
    found = looked_up(out.filter("set is not null"), told, "set", "rows", out.count())
    none = out.filter("set is null").withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit(""), 256))
    both = found.select("row", "doc_id", "n_words", "n_hit", "n_items", "items_sha256").unionByName(none.select("row", "doc_id", "n_words", "n_hit", "n_items", "items_sha256"))
    return both.select("*", ((hit > 0) & (hit * 20 >= n)).alias("contaminated"))
