"""Queries on the graph of windows: build, lookups, filters, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import filters, graph, stats
from strandloom.plans import window_choice
from strandloom.plans.components import component_numbers
from strandloom.plans.queries import query
from strandloom.plans.sequences import COMPONENTS_SQL, E0_GENES, L1_GENES, event_reads, event_sql, order_reads, order_sql, recursive

E3, L3 = event_sql(3), order_sql(3)
LC = recursive(L3) + COMPONENTS_SQL
_NAMED = "list_transform(string_split(node_id, '~~~'), lambda g: g[2:])"
_L_HOT = "list_has_any(" + _NAMED + f", {L1_GENES})"
_FILTERED = """, kept AS (SELECT * FROM nodes WHERE coverage >= 3),
kept_edges AS (SELECT e.* FROM edges e WHERE coverage >= 2 AND src IN (SELECT node_id FROM kept) AND tgt IN (SELECT node_id FROM kept)),
lost AS (SELECT read_id, count(*) AS n, count(*) FILTER (WHERE node_id NOT IN (SELECT node_id FROM kept)) AS lost FROM mers GROUP BY read_id)"""


def _events(spark: SparkSession, sf_dir: str, k: int = 3) -> graph.Graph:
    return graph.build_graph(event_reads(spark, sf_dir), k)


def _orders(spark: SparkSession, sf_dir: str, k: int = 3) -> graph.Graph:
    return graph.build_graph(order_reads(spark, sf_dir), k)


def _cut(spark: SparkSession, sf_dir: str, k: int = 3) -> graph.Graph:
    return graph.cut_graph(order_reads(spark, sf_dir), k)


def _filtered(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return filters.filter_graph(_orders(spark, sf_dir), 3, 2)


@query(E3 + " SELECT read_id, pos, node_id, dir FROM mers")
def gene_mers_k3(spark, sf_dir):
    return graph.gene_mers(event_reads(spark, sf_dir), 3).select("read_id", F.col("pos").cast("long").alias("pos"), "node_id", F.col("dir").cast("int").alias("dir"))


@query(event_sql(5) + " SELECT read_id, pos, node_id, dir FROM mers")
def gene_mers_k5(spark, sf_dir):
    return graph.gene_mers(event_reads(spark, sf_dir), 5).select("read_id", F.col("pos").cast("long").alias("pos"), "node_id", F.col("dir").cast("int").alias("dir"))


@query(L3 + ' SELECT read_id, pos, node_id, pos * 10 AS "start", pos * 10 + 29 AS "end" FROM mers')
def gene_mer_positions(spark, sf_dir):
    return graph.gene_mers(order_reads(spark, sf_dir), 3).select("read_id", F.col("pos").cast("long").alias("pos"), "node_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(E3 + " SELECT * FROM nodes")
def node_coverage(spark, sf_dir):
    return _events(spark, sf_dir).nodes.select("node_id", "coverage", "n_reads")


@query(L3 + " SELECT * FROM nodes")
def node_coverage_orders(spark, sf_dir):
    return _orders(spark, sf_dir).nodes.select("node_id", "coverage", "n_reads")


@query(E3 + " SELECT DISTINCT node_id, read_id FROM mers")
def node_reads(spark, sf_dir):
    return _events(spark, sf_dir).read_nodes.select("node_id", "read_id").distinct()


def _edges(e: DataFrame) -> DataFrame:
    return e.select("src", F.col("src_dir").cast("int").alias("src_dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"), "coverage")


@query(E3 + " SELECT * FROM edges")
def edge_coverage(spark, sf_dir):
    return _edges(_events(spark, sf_dir).edges)


@query(L3 + " SELECT * FROM edges")
def edge_coverage_orders(spark, sf_dir):
    return _edges(_orders(spark, sf_dir).edges)


@query(E3 + " SELECT src, tgt, src_dir * tgt_dir AS turn, arg_min(src_dir, (read_id, pos, side)) AS src_dir, count(*) AS coverage FROM mirrored GROUP BY ALL")
def edge_coverage_collapsed(spark, sf_dir):
    e = graph.build_graph(event_reads(spark, sf_dir), 3, "collapsed").edges
    return e.select("src", "tgt", (F.col("src_dir") * F.col("tgt_dir")).cast("int").alias("turn"), F.col("src_dir").cast("int").alias("src_dir"), "coverage")


@query(L3 + " SELECT n.node_id, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.node_id GROUP BY n.node_id")
def node_degree(spark, sf_dir):
    return graph.degrees(_orders(spark, sf_dir))


@query(L3 + " SELECT node_id FROM nodes n WHERE (SELECT count(*) FROM edges e WHERE e.src = n.node_id) = 1")
def degree_one_nodes(spark, sf_dir):
    return filters.nodes_with_degree(_orders(spark, sf_dir), 1).select("node_id")


@query(E3 + " SELECT src AS node_id, tgt AS neighbour, count(*) AS n FROM edges WHERE src_dir = 1 GROUP BY ALL")
def forward_neighbours(spark, sf_dir):
    return graph.neighbours(_events(spark, sf_dir), 1).groupBy("node_id", "neighbour").agg(F.count("*").alias("n"))


@query(E3 + " SELECT src AS node_id, tgt AS neighbour, count(*) AS n FROM edges WHERE src_dir = -1 GROUP BY ALL")
def backward_neighbours(spark, sf_dir):
    return graph.neighbours(_events(spark, sf_dir), -1).groupBy("node_id", "neighbour").agg(F.count("*").alias("n"))


@query(E3 + " SELECT DISTINCT src AS node_id, tgt AS neighbour FROM edges")
def neighbours(spark, sf_dir):
    return graph.neighbours(_events(spark, sf_dir), distinct=True)


@query(L3 + " SELECT e.src AS a, e.tgt AS b, e.src_dir, e.tgt_dir, e.coverage FROM edges e")
def edges_between_pairs(spark, sf_dir):
    g = _orders(spark, sf_dir)
    pairs = g.edges.select(F.col("src").alias("a"), F.col("tgt").alias("b")).distinct()
    found = graph.edges_between(g, pairs).filter("a = src and b = tgt")
    return found.select("a", "b", F.col("src_dir").cast("int").alias("src_dir"), F.col("tgt_dir").cast("int").alias("tgt_dir"), "coverage")


@query(L3 + " SELECT DISTINCT src AS a, tgt AS b, -tgt_dir AS dir FROM edges")
def direction_between_nodes(spark, sf_dir):
    g = _orders(spark, sf_dir)
    pairs = g.edges.select(F.col("src").alias("a"), F.col("tgt").alias("b")).distinct()
    return graph.direction_between(g, pairs).distinct().select("a", "b", F.col("dir").cast("int").alias("dir"))


@query(L3 + " SELECT DISTINCT a, b FROM (SELECT src AS a, tgt AS b FROM edges)")
def adjacent_nodes(spark, sf_dir):
    g = _orders(spark, sf_dir)
    return graph.adjacent(g, graph.neighbours(g, distinct=True).select(F.col("node_id").alias("a"), F.col("neighbour").alias("b")))


@query(E3 + " SELECT node_id, row_number() OVER (ORDER BY first_read, first_pos) - 1 AS number FROM (SELECT node_id, min((read_id, pos)).read_id AS first_read, min((read_id, pos)).pos AS first_pos FROM mers GROUP BY node_id)".replace("min((read_id, pos)).read_id", "min({'read_id': read_id, 'pos': pos}).read_id").replace("min((read_id, pos)).pos", "min({'read_id': read_id, 'pos': pos}).pos"))
def node_numbers(spark, sf_dir):
    return graph.node_numbers(_events(spark, sf_dir))


@query(L3 + f", d AS (SELECT src, count(*) AS degree FROM edges GROUP BY src) SELECT node_id, CASE WHEN NOT {_L_HOT} THEN 0 WHEN coalesce(degree, 0) <= 2 THEN 1 ELSE 2 END AS colour FROM nodes LEFT JOIN d ON src = node_id")
def node_colours(spark, sf_dir):
    return graph.node_colours(_orders(spark, sf_dir), L1_GENES)


@query(E3 + " SELECT count(*) AS n_nodes, avg(coverage) AS mean_coverage, CAST(sum(coverage) AS BIGINT) AS total_coverage FROM nodes")
def mean_coverage(spark, sf_dir):
    return graph.coverage_stats(_events(spark, sf_dir))


@query(E3 + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT read_id) FROM calls) AS n_reads")
def graph_totals(spark, sf_dir):
    return graph.graph_totals(_events(spark, sf_dir))


@query(L3 + " SELECT coverage // 5 AS bin, count(*) AS n FROM nodes GROUP BY 1")
def coverage_histogram(spark, sf_dir):
    return stats.coverage_histogram(_orders(spark, sf_dir), 5)


@query(order_sql(3, "p_type") + ", r AS (SELECT read_id, any_value(n) AS n FROM calls GROUP BY read_id), c AS (SELECT node_id, k, count(DISTINCT CASE WHEN r.n >= k THEN mers.read_id END) AS c FROM mers JOIN r ON mers.read_id = r.read_id, (VALUES (3), (5), (7), (9), (11), (13), (15)) AS t(k) GROUP BY node_id, k) SELECT k, avg(c) AS mean_reads FROM c GROUP BY k")
def coverage_by_k(spark, sf_dir):
    g = graph.build_graph(order_reads(spark, sf_dir, "p_type"), 3)
    return stats.coverage_by_k(g)


@query(L3 + " SELECT node_id, coverage FROM nodes WHERE coverage < 2")
def low_coverage_nodes(spark, sf_dir):
    return filters.nodes_below(_orders(spark, sf_dir), 2).select("node_id", "coverage")


@query(L3 + ", gone AS (SELECT node_id FROM nodes WHERE coverage < 3) SELECT * FROM edges WHERE coverage < 2 OR src IN (SELECT node_id FROM gone) OR tgt IN (SELECT node_id FROM gone)")
def low_coverage_edges(spark, sf_dir):
    g = _orders(spark, sf_dir)
    return _edges(filters.edges_below(g, 2, filters.nodes_below(g, 3)))


@query(L3 + _FILTERED + " SELECT * FROM kept")
def filter_nodes(spark, sf_dir):
    return _filtered(spark, sf_dir).nodes.select("node_id", "coverage", "n_reads")


@query(L3 + _FILTERED + " SELECT * FROM kept_edges")
def filter_edges(spark, sf_dir):
    return _edges(_filtered(spark, sf_dir).edges)


@query(L3 + _FILTERED + " SELECT read_id FROM lost WHERE lost > 0")
def reads_to_correct(spark, sf_dir):
    return filters.reads_to_correct(_filtered(spark, sf_dir))


@query(L3 + _FILTERED + " SELECT DISTINCT read_id FROM calls WHERE read_id NOT IN (SELECT read_id FROM lost WHERE lost > 0)")
def valid_reads(spark, sf_dir):
    return filters.valid_reads(_filtered(spark, sf_dir)).select("read_id")


@query(L3 + _FILTERED + " SELECT read_id, n, lost, lost <= round_even(n * 0.2, 0) AS kept FROM lost")
def junk_reads(spark, sf_dir):
    return filters.junk_reads(_filtered(spark, sf_dir), 0.8)


@query(L3 + " SELECT read_id, any_value(n) AS n FROM calls GROUP BY read_id HAVING any_value(n) < 3")
def short_reads(spark, sf_dir):
    return graph.short_reads(_orders(spark, sf_dir)).select("read_id", F.size("calls").cast("long").alias("n"))


@query(L3 + f" SELECT node_id, coverage FROM nodes WHERE list_contains({_NAMED}, 'Brand#7')")
def nodes_containing(spark, sf_dir):
    return filters.nodes_containing(_orders(spark, sf_dir), "Brand#7").select("node_id", "coverage")


@query(L3 + f" SELECT node_id, coverage FROM nodes WHERE {_L_HOT}")
def nodes_of_interest(spark, sf_dir):
    return filters.nodes_of_interest(_orders(spark, sf_dir), L1_GENES).select("node_id", "coverage")


@query(L3 + f" SELECT DISTINCT node_id FROM mers WHERE read_id IN (SELECT read_id FROM mers WHERE {_L_HOT})")
def relevance_trim(spark, sf_dir):
    return filters.relevance_trim(_orders(spark, sf_dir), L1_GENES).nodes.select("node_id")


@query(L3 + ", o AS (SELECT DISTINCT read_id, node_id FROM mers) SELECT x.node_id AS a, y.node_id AS b, count(*) AS n FROM o x JOIN o y ON x.read_id = y.read_id GROUP BY ALL HAVING count(*) >= 2")
def shared_reads(spark, sf_dir):
    return filters.shared_reads(_orders(spark, sf_dir), 2)


@query(L3 + " SELECT node_id, n_reads FROM nodes WHERE n_reads >= 3")
def fringe_trim(spark, sf_dir):
    return filters.fringe_trim(_orders(spark, sf_dir), 3).select("node_id", "n_reads")


@query(L3 + " SELECT src AS node_id, src_dir AS dir, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1")
def bubble_starts(spark, sf_dir):
    return filters.bubble_starts(_orders(spark, sf_dir)).select("node_id", F.col("dir").cast("int").alias("dir"), "n")


@query(LC + " SELECT node_id, component FROM numbered")
def components(spark, sf_dir):
    return component_numbers(_cut(spark, sf_dir))


@query(LC + ", best AS (SELECT component FROM numbered JOIN nodes USING (node_id) GROUP BY component HAVING max(coverage) >= 3) SELECT node_id, coverage FROM nodes JOIN numbered USING (node_id) JOIN best USING (component)")
def component_coverage_filter(spark, sf_dir):
    g = _cut(spark, sf_dir)
    return filters.strong_components(g, component_numbers(g), 3).nodes.select("node_id", "coverage")


@query(LC + " SELECT DISTINCT component, read_id FROM numbered JOIN mers USING (node_id)")
def component_reads(spark, sf_dir):
    g = _cut(spark, sf_dir)
    return component_numbers(g).join(g.read_nodes, "node_id").select("component", "read_id").distinct()


@query(LC + f", hot AS (SELECT read_id, any_value(n) >= 5 AS long_enough FROM calls GROUP BY read_id HAVING bool_or(gene[2:] IN ({', '.join(repr(g) for g in L1_GENES)}))), per AS (SELECT DISTINCT component, read_id FROM numbered JOIN mers USING (node_id)), told AS (SELECT component, avg(CAST(long_enough AS INT)) AS share FROM per JOIN hot USING (read_id) GROUP BY component) SELECT component, coalesce(share, 1) >= 0.8 AS valid FROM parts LEFT JOIN told USING (component)")
def component_validity(spark, sf_dir):
    g = _cut(spark, sf_dir)
    return filters.component_is_valid(g.reads, component_numbers(g), g.read_nodes, L1_GENES, 3)


_BY_K = f""", lists AS (SELECT read_id, list(gene ORDER BY pos) AS g FROM calls GROUP BY read_id),
wins AS (SELECT k, read_id, i, g[i:i + k - 1] AS win FROM lists, (VALUES (3), (5), (7)) AS v(k), unnest(range(1, len(g) + 1)) AS t(i) WHERE i + k - 1 <= len(g)),
flips AS (SELECT *, list_reverse(list_transform(win, lambda g: (CASE WHEN g[1] = '+' THEN '-' ELSE '+' END) || g[2:])) AS rc FROM wins),
kn AS MATERIALIZED (SELECT k, read_id, i, array_to_string(CASE WHEN win <= rc THEN win ELSE rc END, '~~~') AS node FROM flips),
near AS MATERIALIZED (SELECT DISTINCT a.k, a.node AS src, b.node AS tgt FROM kn a JOIN kn b ON a.k = b.k AND a.read_id = b.read_id AND abs(a.i - b.i) = 1),
klabel(k, node, label) USING KEY (k, node) AS (SELECT DISTINCT k, node, node FROM kn UNION SELECT e.k, e.tgt, min(c.label) FROM klabel c JOIN near e ON e.k = c.k AND e.src = c.node JOIN recurring.klabel r ON r.k = e.k AND r.node = e.tgt GROUP BY e.k, e.tgt, r.label HAVING min(c.label) < r.label),
per AS (SELECT DISTINCT k, label, read_id FROM kn JOIN klabel USING (k, node)),
told AS (SELECT k, label, avg(CASE WHEN len(list_filter(g, lambda c: c[2:] IN ({', '.join(repr(g) for g in L1_GENES)}))) > 0 THEN CAST(len(g) >= 2 * k - 1 AS INT) END) AS share FROM per JOIN lists USING (read_id) GROUP BY k, label)
SELECT k, count(*) AS n_components, count(*) FILTER (WHERE coalesce(share, 1) >= 0.8) AS n_valid FROM told GROUP BY k"""


@query(recursive(L3) + _BY_K)
def validity_by_k(spark, sf_dir):
    """Of the graphs of 3, 5 and 7 calls, how many components there are and how many keep enough long reads."""
    told = window_choice.validity_by_k(order_reads(spark, sf_dir), (3, 5, 7), L1_GENES)
    return told.groupBy("k").agg(F.count("*").alias("n_components"), F.count_if("valid").alias("n_valid"))


@query(E3 + " SELECT node_id, CAST(2 * coverage AS BIGINT) AS coverage FROM nodes")
def graph_union(spark, sf_dir):
    g = _events(spark, sf_dir)
    return graph.merge_graphs([g, g]).nodes.select("node_id", "coverage")


@query(E3 + f" SELECT DISTINCT read_id FROM mers WHERE list_has_any({_NAMED}, {E0_GENES})")
def reads_in_path(spark, sf_dir):
    g = _events(spark, sf_dir)
    return graph.reads_in_path(g, filters.nodes_of_interest(g, E0_GENES))
