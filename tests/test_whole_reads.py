from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.plans import function_queries


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """A folder with one read of twelve events and one of four, and their calls."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(e, 1 if e < 12 else 2, e, float(e % 3), f"type{e % 5}") for e in range(16)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, value double, event_type string")
    df.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(f"{folder}/events.parquet")
    by = {}
    for _, user, _, value, kind in rows:
        by.setdefault(str(user), []).append(("-" if value % 2 else "+") + kind)
    return folder, by


def test_sublists_of_long_reads(spark, calls):
    folder, by = calls
    expected = Counter((i, ",".join(c[a:b])) for i, c in by.items() for a in range(len(c)) for b in range(a + 1, len(c) + 1))
    assert {(r["read_id"], r["sub"]): r["n"] for r in function_queries.sublists(spark, folder).collect()} == expected


def test_context_options_of_long_reads(spark, calls):
    folder, by = calls
    c = by["1"]
    expected = [("1", "up", ",".join(c[2 - m : 2])) for m in range(3)] + [("1", "down", ",".join(c[4 : 4 + m])) for m in range(len(c) - 3)]
    assert sorted(map(tuple, function_queries.context_options(spark, folder).collect())) == sorted(expected)
