"""What can be told within the row of a read is not shuffled."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
from strandloom.functions import arrays
from strandloom.operators import graph, paths


def test_counted_as_counter(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abc") for _ in range(n)]) for i, n in enumerate((0, 1, 2, 30, 300))] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, a array<string>").select("id", arrays.counted(F.col("a")).alias("c"))
    for r in df.collect():
        own = dict(rows)[r["id"]]
        assert (r["c"] or []) == sorted(Counter(own or []).items())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sublists_are_counted_in_the_row_of_the_read(spark, sf):
    df = __spark_entry__.queries()["sublists"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 1 and " HashAggregate" not in plan


def test_sequences_of_paths_as_by_pairs(spark, monkeypatch):
    rng = random.Random(2)
    reads = [(f"r{i}", [rng.choice("+-") + rng.choice("abc") for _ in range(rng.randint(1, 9))]) for i in range(60)]
    df = spark.createDataFrame(reads, "read_id string, calls array<string>")
    df = df.withColumn("positions", F.transform("calls", lambda _, i: F.when(i % 4 < 3, F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end")))))
    g = graph.build_graph(df, 3).stored()
    bases = df.select("read_id", F.array_join(F.transform("calls", lambda c: F.rpad(c, 3, ".")), "").alias("sequence"))
    step = lambda c: F.struct(F.col(c).alias("node_id"), F.lit(1).alias("dir"))
    three = g.edges.select(F.col("src").alias("x"), F.col("tgt").alias("y")).join(g.edges.select(F.col("src").alias("y"), F.col("tgt").alias("z")), "y")
    wanted = three.select(F.array(step("x"), step("y"), step("z")).alias("path")).distinct()
    nodes = [(r["read_id"], r["node_id"], r["start"], r["end"]) for r in g.read_nodes.collect()]
    text, told = {r["read_id"]: r["sequence"] for r in bases.collect()}, set()
    for (path,) in wanted.collect():
        ids = [s["node_id"] for s in path]
        for read in text:
            at = [(s, e) for r, n, s, e in nodes if r == read and n in ids]
            s, e = [s for s, _ in at if s is not None], [e for _, e in at if e is not None]
            if s and e:
                told.add((tuple(ids), read, text[read][min(s) : max(e) + 1]))
    for most in (4096, 12, 0):
        monkeypatch.setattr(paths, "SHORT_SEQUENCE", most)
        got = [(tuple(s["node_id"] for s in r["path"]), r["read_id"], r["sequence"]) for r in paths.path_sequences(g, wanted, bases).collect()]
        assert len(got) == len(set(got)) and set(got) == told and told
