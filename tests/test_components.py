"""Components of small and large link tables, and the size of the plans of their rounds."""

import random

import pytest

from strandloom.plans import components


def links(seed, nodes, pairs):
    rng = random.Random(seed)
    out = [(rng.randint(0, nodes), rng.randint(0, nodes)) for _ in range(pairs)]
    return out + [(nodes + i, nodes + i + 1) for i in range(40)] + [(2 * nodes + 100, 2 * nodes + 101 + i) for i in range(60)]


def labels(pairs):
    label = {x: x for p in pairs for x in p}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {x: y for x, y in label.items() if any(a != b and x in (a, b) for a, b in pairs)}


@pytest.mark.parametrize("few", [0, 100_000])
def test_few_and_many_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    pairs = links(few, 200, 150)
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == labels(pairs) and len(got) == len(labels(pairs))


def test_plans_of_rounds_are_small(spark, monkeypatch):
    """One plan of both stars had the first star, and the table of links, many times over, which takes the driver's memory."""
    scans, stored = [], components.stored

    def counted(df, label):
        scans.append(df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet"))
        return stored(df, label)

    monkeypatch.setattr(components, "stored", counted)
    components.components(spark.createDataFrame(links(1, 50, 30), "a long, b long")).collect()
    assert max(scans) <= 4
