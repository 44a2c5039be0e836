"""Queries on paths within the graph, blocks, sequences of paths and the results made of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.operators import filters, graph, paths, results, sketch, stats
from strandloom.plans.components import component_numbers
from strandloom.plans.queries import query
from strandloom.plans.sequences import COMPONENTS_SQL, DNA_SQL, L1_GENES, document_dna, order_reads, order_sql, recursive, table
from strandloom.plans.storage import shared_folder
from strandloom.sources import writers

L3 = order_sql(3)
_LISTS = ", lists AS (SELECT read_id, list(gene ORDER BY pos) AS g FROM calls GROUP BY read_id)"
_HOT = f"list_has_any(list_transform(string_split(node_id, '~~~'), lambda g: g[2:]), {L1_GENES})"
_SUBSET = f", sub AS (SELECT node_id FROM nodes WHERE {_HOT}), se AS MATERIALIZED (SELECT * FROM edges WHERE src IN (SELECT node_id FROM sub) AND tgt IN (SELECT node_id FROM sub))"


def _orders(spark, sf_dir):
    return graph.build_graph(order_reads(spark, sf_dir), 3)


@query(L3 + ", w AS (SELECT read_id, list(node_id ORDER BY pos) AS ids FROM mers GROUP BY read_id HAVING count(*) > 1), t AS (SELECT read_id, len(ids) AS n, list_sort([ids[1], ids[-1]]) AS ends FROM w) SELECT read_id, array_to_string(ends, ',') AS ends, max(n) OVER (PARTITION BY ends) AS longest FROM t")
def terminal_groups(spark, sf_dir):
    """Every read's walk with the pair of its ends and the longest walk of that pair."""
    walks = graph.walks_of(_orders(spark, sf_dir)).filter(F.size("walk") > 1).withColumnRenamed("walk", "path")
    return paths.by_terminals(walks).select("read_id", F.array_join("terminals", ",").alias("ends"), F.col("longest").cast("long").alias("longest"))


@query(L3 + _LISTS + ", one AS (SELECT DISTINCT least(g, list_reverse(g)) AS b FROM lists), item AS (SELECT b AS whole, unnest(list_distinct(b)) AS first FROM one), bad AS (SELECT DISTINCT one.b FROM one JOIN item ON item.first = one.b[1] WHERE len(whole) > len(b) AND len(list_filter(range(1, len(whole) - len(b) + 2), lambda i: whole[i:i + len(b) - 1] = b OR whole[i:i + len(b) - 1] = list_reverse(b))) > 0) SELECT array_to_string(b, ',') AS block FROM one WHERE b NOT IN (SELECT b FROM bad)")
def maximal_blocks(spark, sf_dir):
    """The calls of orders that stand in no longer order, either way."""
    blocks = order_reads(spark, sf_dir).select(F.col("calls").alias("block"))
    return filters.maximal_blocks(blocks).select(F.array_join("block", ",").alias("block"))


_STEP = "struct_pack(node_id := {n}, dir := {d})"
_BETWEEN = f""", n AS (SELECT src, count(DISTINCT tgt) FILTER (WHERE src_dir = 1) AS f, count(DISTINCT tgt) FILTER (WHERE src_dir = -1) AS b FROM se GROUP BY src),
ends AS (SELECT node_id FROM sub LEFT JOIN n ON src = node_id WHERE coalesce(f, 0) = 0 OR coalesce(b, 0) = 0),
walk AS (SELECT [{_STEP.format(n="node_id", d="CAST(d AS INT)")}] AS path FROM ends, (VALUES (1), (-1)) AS v(d)
UNION ALL SELECT list_append(path, {_STEP.format(n="e.tgt", d="CAST(e.tgt_dir AS INT)")}) FROM walk JOIN se e ON e.src = path[-1].node_id AND e.src_dir = path[-1].dir WHERE len(path) < 4 AND NOT list_contains(list_transform(path, lambda s: s.node_id), e.tgt)),
found AS (SELECT DISTINCT least(path, list_reverse(list_transform(path, lambda s: {_STEP.format(n="s.node_id", d="-s.dir")}))) AS path FROM walk WHERE len(path) > 1 AND path[-1].node_id IN (SELECT node_id FROM ends))
SELECT array_to_string(list_transform(path, lambda s: s.node_id || ':' || s.dir), ',') AS path FROM found"""


@query(recursive(L3) + _SUBSET + _BETWEEN)
def subset_paths(spark, sf_dir):
    """Walks of up to four nodes of interest from one anchor of their subgraph to another."""
    g = graph.cut_graph(order_reads(spark, sf_dir), 3)
    nodes = filters.nodes_of_interest(g, L1_GENES).select("node_id")
    ends = paths.subset_anchors(g, nodes).filter("anchor").select("node_id")
    found = paths.paths_between(g, nodes, ends, 4)
    return found.select(F.array_join(F.transform("path", lambda s: F.concat_ws(":", s["node_id"], s["dir"].cast("string"))), ",").alias("path"))


@query(L3 + _SUBSET + ", p AS (SELECT DISTINCT src, tgt FROM se WHERE src < tgt), at AS (SELECT src, tgt, src AS node_id FROM p UNION ALL SELECT src, tgt, tgt FROM p), hit AS (SELECT src, tgt, read_id, min(pos) * 10 AS s, max(pos) * 10 + 29 AS e FROM at JOIN mers USING (node_id) GROUP BY ALL), seq AS (SELECT read_id, string_agg(rpad(gene, 10, '.'), '' ORDER BY pos) AS bases FROM calls GROUP BY read_id) SELECT src, tgt, read_id, substr(bases, s + 1, e - s + 1) AS sequence FROM hit JOIN seq USING (read_id)".replace(" at AS", " spots AS").replace("FROM at JOIN", "FROM spots JOIN"))
def path_sequences(spark, sf_dir):
    """Of each read what lies along each edge between nodes of interest, ten letters a call."""
    g = graph.cut_graph(order_reads(spark, sf_dir), 3)
    nodes = filters.nodes_of_interest(g, L1_GENES).select("node_id")
    step = lambda n: F.struct(F.col(n).alias("node_id"), F.lit(1).alias("dir"))
    edges = paths.subgraph_edges(g, nodes).filter("src < tgt").select(F.array(step("src"), step("tgt")).alias("path")).distinct()
    bases = g.reads.select("read_id", F.array_join(F.transform("calls", lambda c: F.rpad(c, 10, ".")), "").alias("sequence"))
    found = paths.path_sequences(g, edges, bases)
    return found.select(F.col("path")[0]["node_id"].alias("src"), F.col("path")[1]["node_id"].alias("tgt"), "read_id", "sequence")


@query(recursive(L3) + COMPONENTS_SQL + " SELECT DISTINCT component AS cluster, read_id FROM numbered JOIN mers USING (node_id)")
def cluster_reads(spark, sf_dir):
    """The reads of each cluster of nodes, a node's component being its cluster."""
    g = graph.cut_graph(order_reads(spark, sf_dir), 3)
    clusters = component_numbers(g).select(F.col("node_id").alias("path_id"), F.col("component").alias("cluster"))
    return sketch.merged_clusters(clusters, g.read_nodes.select(F.col("node_id").alias("path_id"), "read_id"))


_KMERS = f"k AS (SELECT read_id, unnest(range(1, len(sequence) - 13)) AS i, sequence FROM ({DNA_SQL}) WHERE len(sequence) >= 15), m AS MATERIALIZED (SELECT read_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT read_id, sequence[i:i + 14] AS s FROM k))"


@query(f"WITH {_KMERS}, c AS (SELECT kmer, count(*) AS n FROM m GROUP BY kmer), p AS (SELECT source AS path_id, CAST(doc_id AS VARCHAR) AS read_id, 1 + doc_id % 3 AS copies FROM documents), seen AS (SELECT path_id, kmer, max(copies) AS copies FROM p JOIN (SELECT DISTINCT * FROM m) USING (read_id) GROUP BY ALL) SELECT path_id, CAST(median(n) AS DOUBLE) AS path_depth, median(n) / 2.5 AS relative_depth, median(n) / 2.5 / max(seen.copies) AS copy_number FROM seen JOIN c USING (kmer) GROUP BY path_id")
def path_copy_numbers(spark, sf_dir):
    """Each source as a path, its documents as reads with one to three copies, at a depth of 2.5."""
    dna = document_dna(spark, sf_dir)
    reads = table(spark, sf_dir, "documents").select(F.col("source").alias("path_id"), F.col("doc_id").cast("string").alias("read_id"), (1 + F.col("doc_id") % 3).alias("copies"))
    return stats.sequence_copy_numbers(dna, reads, 2.5)


@query("WITH best AS (SELECT p_brand AS allele, p_type AS rname, CAST(max(p_size) AS INT) AS length, any_value(n) AS n_reads FROM part JOIN (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1) ON b = p_brand WHERE p_size > 40 GROUP BY ALL), told AS (SELECT allele, n_reads, rname, length, CASE WHEN length > 45 THEN 'kind of ' || rname END AS phenotype FROM best), ranked AS (SELECT *, row_number() OVER (PARTITION BY allele ORDER BY rname) AS i FROM told) SELECT allele, n_reads, max(rname) FILTER (WHERE i = 1) AS determinant_name, max(phenotype) FILTER (WHERE i = 1) AS sequence_name, string_agg(rname, '/' ORDER BY rname) AS closest_reference, string_agg(length, '/' ORDER BY rname) AS reference_length FROM ranked GROUP BY allele, n_reads".replace("CASE WHEN length > 45 THEN 'kind of ' || rname END AS phenotype", "CASE WHEN rname IN (SELECT p_type FROM part WHERE p_size > 45) THEN 'kind of ' || rname END AS phenotype"))
def tied_results(spark, sf_dir):
    """A row per brand with all its large types as references, tied; phenotypes are known of some types."""
    part = table(spark, sf_dir, "part")
    counts = part.groupBy(F.col("p_brand").alias("allele")).agg(F.count("*").alias("n_reads"))
    best = part.filter("p_size > 40").groupBy(F.col("p_brand").alias("allele"), F.col("p_type").alias("rname")).agg(F.max("p_size").alias("length"))
    best = best.join(counts, "allele").withColumns({"identity": F.lit(100.0), "coverage": F.lit(1.0), "cigar": F.lit("")})
    kinds = part.filter("p_size > 45").select(F.col("p_type").alias("allele")).distinct().withColumn("phenotype", F.concat(F.lit("kind of "), "allele"))
    out = results.result_rows(best, kinds)
    return out.select("allele", "n_reads", "determinant_name", "sequence_name", F.array_join("closest_reference", "/").alias("closest_reference"), F.array_join(F.col("reference_length").cast("array<string>"), "/").alias("reference_length"))


@query("WITH r AS (SELECT p_brand AS allele, count(*) AS n_reads, string_agg(DISTINCT p_type, '/' ORDER BY p_type) AS names FROM part GROUP BY p_brand) SELECT * FROM r")
def results_file(spark, sf_dir):
    """Tab-separated results with arrays of ties, and an empty table with its header, read back."""
    folder = f"{shared_folder(spark)}/strandloom/files-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("allele")).agg(F.count("*").alias("n_reads"), F.array_sort(F.collect_set("p_type")).alias("names"))
    writers.write_results(rows, f"{folder}/full")
    writers.write_results(rows.limit(0), f"{folder}/empty")
    read = lambda name: spark.read.csv(f"{folder}/{name}", sep="\t", header=True)
    return read("full").unionByName(read("empty")).select("allele", F.col("n_reads").cast("long").alias("n_reads"), "names")
