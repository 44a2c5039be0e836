"""What is stored in the shared folder, and how it goes."""

from strandloom.plans import storage
from strandloom.plans.storage import dropped, forget, looked_up, stored


def test_old_tables_go_and_new_ones_stay(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    assert forget(spark) == 0
    kept = stored(spark.range(3), "kept")
    assert forget(spark, 1.0) == 0 and kept.count() == 3
    gone = stored(spark.range(2), "gone")
    dropped(gone)
    assert not any("/gone-" in f for f in kept.inputFiles())
    assert forget(spark, -1.0) >= 1 and forget(spark, -1.0) == 0


def test_look_ups_with_hot_keys_and_counts(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 5000 + ["a", "b", "none"])], "k string, i int")
    right = spark.createDataFrame([("hot", 5000, 1), ("a", 1, 2), ("b", 1, 3)], "k string, n long, v int")
    got = looked_up(left, right, "k", "n", 5003)
    assert {(r["k"], r["v"]) for r in got.select("k", "v").distinct().collect()} == {("hot", 1), ("a", 2), ("b", 3), ("none", None)} and got.count() == 5003
    assert looked_up(left, right, "k", "n", 5003, keep=True).columns == ["k", "i", "n", "v"]
