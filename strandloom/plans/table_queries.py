"""Queries on calls, depths, references and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import tokens
from strandloom.operators import filters, graph, paths, results, stats
from strandloom.plans.queries import query
from strandloom.plans.sequences import L1_GENES, event_reads, event_sql, order_reads, order_sql, table
from strandloom.sources import readers, writers

E3, L3 = event_sql(3), order_sql(3)


def _calls(spark, sf_dir):
    rows = order_reads(spark, sf_dir).select("read_id", F.posexplode("calls").alias("pos", "call"))
    return rows.withColumn("name", F.substring("call", 2, 1 << 30))


@query(L3 + ", c AS (SELECT gene[2:] AS name, count(*) AS n FROM calls GROUP BY 1) SELECT name, n FROM c WHERE n >= (SELECT avg(n) FROM c)")
def low_frequency_filter(spark, sf_dir):
    return readers.frequent_calls(_calls(spark, sf_dir), 1.0).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS read_id, p_brand AS name, CAST(l_quantity AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_quantity AS BIGINT) BETWEEN 0.5 * p_size AND 1.5 * p_size OR p_brand IN ('Brand#7', 'Brand#17')")
def length_window_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("name"), F.col("l_quantity").cast("long").alias("n"))
    lengths = part.select(F.col("p_partkey").alias("name"), F.col("p_size").alias("length"))
    kept = readers.length_window(rows, lengths, [], 0.5, 1.5)
    exempt = rows.join(part.filter(F.col("p_brand").isin(L1_GENES)).select(F.col("p_partkey").alias("name")), "name", "left_semi")
    brand = part.select(F.col("p_partkey").alias("name"), "p_brand")
    fits = kept.join(brand.filter(~F.col("p_brand").isin(L1_GENES)), "name").unionByName(exempt.join(brand, "name"))
    return fits.select("read_id", F.col("p_brand").alias("name"), "n")


@query(L3 + ", c AS (SELECT gene[2:] AS name, count(*) AS n FROM calls GROUP BY 1) SELECT coalesce(avg(n), 0) AS mean_depth FROM c WHERE name IN (SELECT p_brand FROM part WHERE p_size < 5)")
def core_mean_count(spark, sf_dir):
    counts = _calls(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    return stats.core_gene_depth(counts, table(spark, sf_dir, "part").filter("p_size < 5").select(F.col("p_brand").alias("name")))


_SPANS = "SELECT p_brand AS name, CAST(p_size AS BIGINT) AS s, CAST(p_size AS BIGINT) + p_partkey % 7 AS e FROM part"


def _spans(spark, sf_dir):
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), size.alias("start"), (size + F.col("p_partkey") % 7).alias("end"))


@query(f"SELECT name, pos, count(*) AS depth FROM (SELECT name, unnest(range(s, e + 1)) AS pos FROM ({_SPANS})) GROUP BY ALL")
def interval_depth(spark, sf_dir):
    return readers.interval_depth(_spans(spark, sf_dir))


_DEPTHS = f"SELECT name, pos, count(*) AS depth FROM (SELECT name, unnest(range(s, e + 1)) AS pos FROM ({_SPANS.replace('p_size AS BIGINT)', 'p_size * p_size * p_size AS BIGINT)')})) GROUP BY ALL"


def _far_spans(spark, sf_dir):
    start = F.pow("p_size", 3).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), start.alias("start"), (start + F.col("p_partkey") % 7).alias("end"))


@query(f"WITH d AS ({_DEPTHS}), i AS (SELECT *, pos - row_number() OVER (PARTITION BY name, depth ORDER BY pos) AS island FROM d) SELECT name, min(pos) AS first, max(pos) AS last, depth FROM i GROUP BY name, depth, island")
def depth_intervals(spark, sf_dir):
    """Spans of a part's brand from the cube of its size on, so that most of a reference is not covered."""
    return readers.depth_intervals(_far_spans(spark, sf_dir))


@query(f"WITH d AS ({_DEPTHS}), i AS (SELECT *, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS island FROM d), r AS (SELECT name, min(pos) AS first, max(pos) AS last FROM i GROUP BY name, island) SELECT name, first, last FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY last - first DESC, first) = 1")
def longest_covered_parts(spark, sf_dir):
    return readers.longest_covered_parts(_far_spans(spark, sf_dir))


@query(f"SELECT name, min(pos) AS first, max(pos) AS last, count(DISTINCT pos) / 100 AS covered FROM (SELECT name, unnest(range(s, e + 1)) AS pos FROM ({_SPANS})) GROUP BY name")
def pileup(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return readers.pileup(spans, spans.select("name").distinct().withColumn("length", F.lit(100)))


@query(f"SELECT name, 1 - count(DISTINCT pos) / 100 AS uncovered FROM (SELECT name, unnest(range(s, e + 1)) AS pos FROM ({_SPANS})) GROUP BY name")
def uncovered_share(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    cigar = F.array(F.struct(F.lit(0).alias("op"), (F.col("end") - F.col("start") + 1).cast("int").alias("len")))
    align = spans.select(F.lit(0).alias("flag"), F.col("name").alias("rname"), (F.col("start") + 1).cast("int").alias("pos"), cigar.alias("cigar"))
    return readers.uncovered_share(align, spans.select("name").distinct().withColumn("length", F.lit(100)))


@query(L3 + " SELECT node_id, coverage, n_reads FROM nodes ORDER BY coverage DESC, node_id LIMIT 10")
def top_path(spark, sf_dir):
    g = graph.build_graph(order_reads(spark, sf_dir), 3)
    return g.nodes.select("node_id", "coverage", "n_reads").orderBy(F.desc("coverage"), "node_id").limit(10)


@query("SELECT source AS allele, arg_min(CAST(doc_id AS VARCHAR), (-length(text), CAST(doc_id AS VARCHAR))) AS read_id, max(length(text)) AS length FROM documents GROUP BY source")
def longest_sequence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    alleles = docs.select(F.col("source").alias("allele"), F.col("doc_id").cast("string").alias("read_id"))
    out = writers.longest_reads(alleles, docs.select(F.col("doc_id").cast("string").alias("read_id"), F.col("text").alias("sequence")))
    return out.withColumn("length", F.col("length").cast("long"))


@query("WITH b AS (SELECT p_brand AS rname, max(p_size / 50) AS coverage, max(p_partkey % 97 / 97) AS match FROM part GROUP BY p_brand) SELECT rname, coverage >= 0.85 AS valid, rank() OVER (PARTITION BY coverage >= 0.85 ORDER BY least(1.0, coverage) DESC, match DESC) AS rank FROM b")
def closest_reference(spark, sf_dir):
    """Parts as alignments to their brand, of 50 x 97 bases: of 97 query bases p_partkey mod 97 are equal, and p_size x 97 bases are covered."""
    n, size = (F.col("p_partkey") % 97).cast("int"), F.col("p_size").cast("int")
    op = lambda o, x: F.struct(F.lit(o).alias("op"), x.cast("int").alias("len"))
    cigar = F.array(op(tokens.EQUAL, n), op(tokens.DIFF, F.lit(97) - n), op(tokens.DELETE, (size - 1) * 97))
    align = table(spark, sf_dir, "part").select(F.lit(0).alias("flag"), F.col("p_brand").alias("rname"), F.col("p_partkey").cast("string").alias("qname"), cigar.alias("cigar"))
    refs = align.select("rname").distinct().withColumn("length", F.lit(50 * 97))
    return results.closest_alleles(align, refs, 0.9).select("rname", "valid", F.col("rank").cast("long").alias("rank"))


@query(L3 + " SELECT DISTINCT read_id FROM calls ORDER BY md5('2024|' || read_id), read_id LIMIT 100")
def sample_sequences(spark, sf_dir):
    return readers.sample_reads(order_reads(spark, sf_dir), 100).select("read_id")


@query(L3 + " SELECT DISTINCT read_id FROM calls WHERE gene[2:] = 'Brand#7' INTERSECT SELECT DISTINCT read_id FROM calls WHERE gene[2:] = 'Brand#17'")
def sequence_intersect(spark, sf_dir):
    with_ = lambda n: _calls(spark, sf_dir).filter(F.col("name") == n).select("read_id")
    return with_("Brand#7").intersect(with_("Brand#17"))


@query("WITH p AS (SELECT DISTINCT p_brand AS part FROM part WHERE p_size < 3), g AS (SELECT DISTINCT p_brand || '#' || p_size AS gene FROM part) SELECT gene, part AS allele FROM g JOIN p ON contains(gene, part)")
def promoter_theta_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    genes = part.select(F.concat_ws("#", "p_brand", "p_size").alias("gene")).distinct()
    promoters = part.filter("p_size < 3").select(F.concat("p_brand", F.lit("_promoter")).alias("gene"), F.col("p_brand").alias("allele"), F.lit("ACGT").alias("sequence")).distinct()
    return readers.attach_promoters(genes, promoters).select("gene", "allele")


@query("WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS allele, p_retailprice % 100 AS identity, p_size * 2.0 AS coverage, (p_partkey % 13) / 10.0 AS relative_depth FROM part) SELECT allele, CASE WHEN coverage < 90 THEN 'Partially present gene.' ELSE '' END AS comments FROM r WHERE identity >= 20 AND coverage >= 80 AND relative_depth >= 0.2")
def result_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("allele"), (F.col("p_retailprice") % 100).alias("identity"), (F.col("p_size") * 2.0).alias("coverage"), ((F.col("p_partkey") % 13) / 10.0).alias("relative_depth"))
    alleles = rows.select("allele", F.lit("r").alias("read_id"))
    reads = spark.createDataFrame([("r", ["+other"])], "read_id string, calls array<string>")
    out = results.filter_results(rows, alleles, reads, L1_GENES, 0.2, 0.8, 0.2, 30.0)
    return out.select("allele", "comments")


@query()
def mixture_cutoff(spark, sf_dir):
    g = graph.build_graph(order_reads(spark, sf_dir), 3)
    pairs = [(r["coverage"], r["n"]) for r in g.nodes.groupBy("coverage").agg(F.count("*").alias("n")).collect()]  # a histogram
    return spark.createDataFrame([(stats.mixture_cutoff(pairs), stats.peak_depth(pairs))], "cutoff int, peak int")


@query(E3 + " SELECT x.read_id FROM (SELECT read_id, list(gene ORDER BY pos) AS g FROM calls GROUP BY read_id) x WHERE len(list_filter(range(1, len(g)), lambda i: g[i] = '+view' AND g[i + 1] = '+click')) > 0")
def path_support(spark, sf_dir):
    reads = event_reads(spark, sf_dir).select("read_id", F.col("calls").alias("items"))
    path = spark.createDataFrame([(["+view", "+click"],)], "path array<string>")
    return paths.path_places(reads, path).select("read_id")


_GML = """, kept AS (SELECT n.node_id, n.coverage, row_number() OVER (ORDER BY f.seen) - 1 AS number FROM nodes n JOIN (SELECT node_id, min({'read_id': read_id, 'pos': pos}) AS seen FROM mers GROUP BY node_id) f ON f.node_id = n.node_id WHERE n.coverage >= 3),
r AS (SELECT node_id, string_agg(read_id, ',' ORDER BY read_id) AS reads FROM (SELECT DISTINCT node_id, read_id FROM mers) GROUP BY node_id)
SELECT 0 AS part, 0 AS a, 0 AS b, 'graph' || chr(9) || '[' AS value
UNION ALL SELECT 3, 0, 0, ']'
UNION ALL SELECT 1, number, 0, replace(replace('>node>[|>>id ' || number || '|>>label "' || kept.node_id || '"|>>coverage ' || coverage || '|>>reads "' || reads || '"|>]', '>', chr(9)), '|', chr(10)) FROM kept JOIN r ON r.node_id = kept.node_id
UNION ALL SELECT 2, s.number, t.number, replace(replace('>edge>[|>>source ' || s.number || '|>>target ' || t.number || '|>>source_direction ' || src_dir || '|>>target_direction ' || tgt_dir || '|>>weight ' || edges.coverage || '|>]', '>', chr(9)), '|', chr(10)) FROM edges JOIN kept s ON s.node_id = src JOIN kept t ON t.node_id = tgt"""


@query(L3 + _GML)
def gml(spark, sf_dir):
    g = filters.filter_graph(graph.cut_graph(order_reads(spark, sf_dir), 3), 3, 1).stored()
    return writers.gml_lines(g)


@query(L3 + " SELECT n AS n_calls, count(DISTINCT read_id) AS n_reads FROM calls GROUP BY n")
def read_length_histogram(spark, sf_dir):
    return writers.read_length_histogram(order_reads(spark, sf_dir)).withColumn("n_calls", F.col("n_calls").cast("long"))
