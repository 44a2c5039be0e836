"""Which texts contain which parts, by an index of q-grams instead of comparing all with all.

A text that contains a part contains each run of ``Q`` letters of it. Texts are indexed by their
distinct runs, a part is looked up by the one of its runs that the fewest texts have, and what is found is verified. Parts
shorter than ``Q`` are runs themselves, of their own length. The empty part is in every
text; its pairs are dealt out by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.plans.storage import stored

Q, DEALS = 4, 64


def _grams(text: Column, n: Column | int) -> Column:
    """All distinct runs of n letters."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part): pairs of distinct texts (text) and parts (part) of which the text contains the part. Nulls contain nothing and are in nothing."""
    texts, parts = stored(texts.filter("text is not null").select("text").distinct(), "texts"), stored(parts.filter("part is not null").select("part").distinct(), "parts")
    sizes = parts.filter("part <> ''").select(F.least(F.length("part"), F.lit(Q)).alias("n")).distinct()
    sizes = [r["n"] for r in sizes.collect()]  # Q at most
    runs = F.flatten(F.array(*(_grams(F.col("text"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    index = stored(texts.select("text", F.explode(runs).alias("gram")), "grams")
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = parts.filter("part <> ''").select("part", F.explode(_grams(F.col("part"), F.least(F.length("part"), F.lit(Q)))).alias("gram"))
    # A run that no text has rules its part out; else the rarest one leads to the texts.
    rarest = own.join(frequency, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("part", "r.gram")
    found = index.join(rarest, "gram").filter(F.col("text").contains(F.col("part"))).select("text", "part")
    empty = parts.filter("part = ''").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    everywhere = texts.withColumn("deal", F.pmod(F.xxhash64("text"), F.lit(DEALS)).cast("int")).join(empty.hint("shuffle_hash"), "deal").select("text", "part")
    return found.union(everywhere)
