from strandloom.plans import graph_queries, path_queries


def orders(spark, folder, *reads):
    """Tables of orders whose lines have the symbols of ``reads``."""
    keys = {s: i for i, s in enumerate(sorted({s for r in reads for s in r.split()}))}
    lines = [(o, keys[s], 0, n, "N", 0) for o, r in enumerate(reads) for n, s in enumerate(r.split())]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate int").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, s) for s, i in keys.items()], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_junction_paths_of_eight_nodes(spark, tmp_path):
    folder = orders(spark, tmp_path, "A B C x1 x2 x3 x4 D E F", "A B C y1 y2 y3 y4 D E F")
    got = [r["path"].split(",") for r in path_queries.junction_paths(spark, folder).collect()]
    assert [len(p) for p in got] == [8, 8] and got[0] != got[1]


def test_lookups_of_weak_edges(spark, tmp_path):
    folder = orders(spark, tmp_path, "A B C D")
    u, v = "+A~~~+B~~~+C", "+B~~~+C~~~+D"
    assert sorted(map(tuple, graph_queries.edges_between_pairs(spark, folder).collect())) == [(u, v, 1, 1, 1), (v, u, -1, -1, 1)]
    assert sorted(map(tuple, graph_queries.direction_between_nodes(spark, folder).collect())) == [(u, v, -1), (v, u, 1)]
