"""Queries on files and their round trips, alignments, lookups on the graph, and results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.functions import arrays, tokens
from strandloom.operators import filters, graph, paths, results, stats
from strandloom.plans.queries import query
from strandloom.plans.sequences import DNA_SQL, L1_GENES, document_dna, event_reads, event_sql, order_reads, order_sql, table
from strandloom.plans.storage import shared_folder
from strandloom.sources import readers, writers

E3, L3 = event_sql(3), order_sql(3)
_LISTS = ", lists AS (SELECT read_id, list(gene ORDER BY pos) AS g FROM calls GROUP BY read_id)"
_HOT = f"list_has_any(list_transform(string_split(node_id, '~~~'), lambda g: g[2:]), {L1_GENES})"


def _folder(spark):
    return f"{shared_folder(spark)}/strandloom/files-{uuid.uuid4().hex}"


def _orders(spark, sf_dir):
    return graph.build_graph(order_reads(spark, sf_dir), 3)


def _events(spark, sf_dir):
    return event_reads(spark, sf_dir)


# Files.


@query(f"SELECT read_id, md5(sequence) AS digest, CAST(len(sequence) AS BIGINT) AS n_quality FROM ({DNA_SQL}) WHERE sequence <> ''")
def fastq_round_trip(spark, sf_dir):
    """Gzipped FASTQ of all documents' sequences, read back; empty ones are not written."""
    path = _folder(spark)
    writers.write_fastq(document_dna(spark, sf_dir).withColumn("quality", F.repeat(F.lit("@"), F.length("sequence"))), path)
    return readers.read_fastq(spark, path).select("read_id", F.md5("sequence").alias("digest"), F.length("quality").cast("long").alias("n_quality"))


@query(f"SELECT read_id, md5(sequence) AS digest, repeat('I', len(sequence)) = repeat('I', len(sequence)) AS filled FROM ({DNA_SQL}) WHERE sequence <> ''")
def fasta_round_trip(spark, sf_dir):
    path = _folder(spark)
    writers.write_fasta(document_dna(spark, sf_dir).filter("sequence <> ''"), path)
    return readers.read_fasta(spark, path).select("read_id", F.md5("sequence").alias("digest"), (F.length("quality") == F.length("sequence")).alias("filled"))


@query(L3 + _LISTS + " SELECT read_id, array_to_string(g, ',') AS calls, CAST(len(g) * 10 - 1 AS BIGINT) AS last FROM lists")
def calls_round_trip(spark, sf_dir):
    """JSON lines of all reads, and the maps of calls and positions that readers take, one on each line."""
    path = _folder(spark)
    reads = order_reads(spark, sf_dir)
    writers.write_calls(reads, f"{path}/lines")
    lines = spark.read.schema(graph.READS).json(f"{path}/lines")
    entry = lambda c: F.concat(F.lit('{"'), "read_id", F.lit('":'), F.to_json(c), F.lit("}")).alias("value")
    one = lines.select(entry(F.col("calls")), entry(F.transform("positions", lambda p: F.array(p["start"], p["end"]))).alias("places"))
    one.select("value").write.text(f"{path}/calls", lineSep="\n")
    one.select("places").write.text(f"{path}/places", lineSep="\n")
    back = readers.read_calls(spark, f"{path}/calls", f"{path}/places", lines=True)
    return back.select("read_id", F.array_join("calls", ",").alias("calls"), F.element_at("positions", -1)["end"].cast("long").alias("last"))


@query("WITH n AS (SELECT p_brand AS kmer, count(*) AS n FROM part GROUP BY p_brand) SELECT kmer, n FROM n WHERE n <> 0")
def kmer_counts_file(spark, sf_dir):
    path = _folder(spark)
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    zero = counts.select(F.concat(F.lit("none"), "p_brand").alias("p_brand"), F.lit(0).cast("long").alias("n"))
    counts.unionByName(zero).select(F.concat_ws(" ", "p_brand", F.col("n").cast("string"))).write.text(path)
    return readers.read_kmer_counts(spark, path)


@query('SELECT CAST(p_size AS BIGINT) AS "count", count(*) AS n_kmers FROM part GROUP BY p_size')
def histogram_file(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).select(F.concat_ws(" ", F.col("p_size").cast("string"), F.col("n").cast("string"))).write.text(path)
    return readers.read_histogram(spark, path)


@query("SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 5 AND p_brand IN (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)")
def genes_present(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "part").filter("p_size < 5").select(F.concat(F.lit(" "), "p_brand")).write.text(path)
    return readers.genes_present(order_reads(spark, sf_dir), readers.read_names(spark, path))


@query("WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS read_id, source AS allele, length(text) AS n FROM documents) SELECT allele || ';' || lang AS allele, array_to_string(list(DISTINCT read_id ORDER BY read_id), ',') AS reads FROM s JOIN (SELECT source, max(lang) AS lang FROM documents GROUP BY source) ON source = allele GROUP BY ALL")
def reads_per_allele(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    alleles = docs.select(F.col("source").alias("allele"), F.col("doc_id").cast("string").alias("read_id"))
    closest = docs.groupBy(F.col("source").alias("allele")).agg(F.max("lang").alias("closest_reference"))
    return writers.reads_per_allele(alleles, closest).select("allele", F.array_join("reads", ",").alias("reads"))


@query(f"WITH a AS (SELECT source AS allele, CAST(doc_id AS VARCHAR) AS read_id, 40 AS s, 69 + length(lang) AS e FROM documents) SELECT allele, d.read_id, md5(sequence[1:least(len(sequence) - 1, e + 30) + 1][greatest(s - 30, 0) + 1:]) AS digest FROM a JOIN ({DNA_SQL}) d ON d.read_id = a.read_id")
def allele_slices(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    places = docs.select(F.col("source").alias("allele"), F.col("doc_id").cast("string").alias("read_id"), F.lit(40).alias("start"), (F.length("lang") + 69).alias("end"))
    reads = document_dna(spark, sf_dir).withColumn("quality", F.col("sequence"))
    return writers.allele_slices(places, reads, 30).filter("sequence = quality").select("allele", "read_id", F.md5("sequence").alias("digest"))


# Alignments and their cigars.


@query("SELECT p_partkey, CAST(p_size - 1 AS BIGINT) AS first, p_partkey % 50 + p_partkey % 7 + 5 AS n, p_size - 1 + p_partkey % 50 + p_partkey % 7 + 4 AS last, (CASE WHEN p_partkey % 2 = 1 THEN '-' ELSE '+' END) || p_brand || ';x' AS call FROM part")
def alignment_regions(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit("H"), (F.col("p_partkey") % 50 + 1).cast("string"), F.lit("M"), (F.col("p_partkey") % 7 + 1).cast("string"), F.lit("S2="), F.lit("1X"))
    rows = table(spark, sf_dir, "part").select("p_partkey", tokens.parse_cigar(text).alias("cigar"), F.concat("p_brand", F.lit("~~~x.aln.fas")).alias("rname"), (F.col("p_partkey") % 2 * 16).cast("int").alias("flag"))
    rows = rows.withColumn("first", tokens.region_start(F.col("cigar"))).withColumn("n", tokens.region_length(F.col("cigar")))
    return rows.select("p_partkey", F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n"), tokens.region_end(F.col("cigar"), F.col("first")).cast("long").alias("last"), tokens.mapped_call(F.col("rname"), F.col("flag")).alias("call"))


_REGIONS = """WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS read_id, p_brand AS name, l_linenumber * 10 AS s, CAST(l_quantity AS BIGINT) AS n, (CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END) || p_brand AS call FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT * FROM a WHERE n BETWEEN 12.5 AND 37.5 OR name IN ('Brand#7', 'Brand#17')), c AS (SELECT name, count(*) AS seen FROM w GROUP BY name)"""


@query(_REGIONS + " SELECT read_id, array_to_string(list(call ORDER BY s, s + n - 1, call), ',') AS calls, CAST(max(s + n - 1) AS BIGINT) AS last FROM w WHERE name IN (SELECT name FROM c WHERE seen >= 0.2 * (SELECT avg(seen) FROM c)) GROUP BY read_id")
def aligned_reads(spark, sf_dir):
    """Reads from alignments of the lines of orders to brands: a line's place is its number, its length the quantity."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    align = rows.select(F.col("l_orderkey").cast("string").alias("qname"), F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"), F.col("p_brand").alias("rname"), F.array(op(tokens.HARD_CLIP, F.col("l_linenumber") * 10 + 1), op(tokens.EQUAL, F.col("l_quantity"))).alias("cigar"))
    lengths = align.select(F.col("rname").alias("name")).distinct().withColumn("length", F.lit(25))
    out = readers.calls_from_alignments(align, lengths, L1_GENES)
    return out.select("read_id", F.array_join("calls", ",").alias("calls"), F.array_max(F.col("positions.end")).cast("long").alias("last"))


def _spans(spark, sf_dir):
    n = (F.col("p_partkey") % 7 + 1).cast("int")
    return table(spark, sf_dir, "part").select(F.lit(0).alias("flag"), F.col("p_brand").alias("rname"), (F.col("p_size") + 1).alias("pos"), F.array(F.struct(F.lit(0).alias("op"), n.alias("len"))).alias("cigar"))


def _brands(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("length", F.lit(100))


@query("SELECT p_brand AS name, sum(p_partkey % 7 + 1) / 100 AS mean_depth FROM part GROUP BY p_brand")
def mean_depths(spark, sf_dir):
    return readers.mean_depths(_spans(spark, sf_dir), _brands(spark, sf_dir))


@query("WITH c AS (SELECT p_brand AS name, count(DISTINCT pos) AS n FROM part, unnest(range(p_size, p_size + p_partkey % 7 + 1)) AS t(pos) GROUP BY p_brand) SELECT name FROM c WHERE 1 - n / 100 > 0.45 AND name NOT IN ('Brand#7', 'Brand#17')")
def poorly_mapped(spark, sf_dir):
    return readers.poorly_mapped(_spans(spark, sf_dir), _brands(spark, sf_dir), L1_GENES, 0.45)


_ALN = ", aln AS (SELECT read_id, list_transform(list_zip(g, list_reverse(g)), lambda p: struct_pack(a := CASE WHEN p[1][2:] = 'error' THEN '*' ELSE p[1] END, b := CASE WHEN p[2][2:] = 'view' THEN '*' ELSE p[2] END)) AS x FROM lists)"
_FLIP = "CASE WHEN {c} = '*' THEN '*' WHEN {c}[1] = '+' THEN '-' || {c}[2:] ELSE '+' || {c}[2:] END"


@query(E3 + _LISTS + _ALN + f" SELECT read_id, CAST(len(list_filter(x, lambda c: c.a <> c.b AND c.a <> '*' AND c.b <> '*')) AS BIGINT) AS snps, CAST(len(list_filter(x, lambda c: (c.a = '*') <> (c.b = '*'))) AS BIGINT) AS indels, array_to_string(list_transform(x, lambda c: CASE WHEN c.b = '*' THEN c.a ELSE c.b END), ',') AS merged, array_to_string(list_transform(list_reverse(x), lambda c: {_FLIP.format(c='c.a')}), ',') AS flipped, array_to_string(list_filter(range(0, len(x)), lambda i: x[i + 1].a <> '*'), ',') AS first_row FROM aln")
def alignment_columns(spark, sf_dir):
    """Each read against its reverse, with errors and views as gaps: counts, the merged row, the other strand, and columns without gaps."""
    calls = F.col("calls")
    gap = lambda x, name: F.when(tokens.call_name(x) == name, "*").otherwise(x)
    aln = F.zip_with(calls, F.reverse(calls), lambda a, b: F.struct(gap(a, "error").alias("a"), gap(b, "view").alias("b")))
    rows = _events(spark, sf_dir).select("read_id", aln.alias("x"))
    x = F.col("x")
    return rows.select("read_id", arrays.snps(x).cast("long").alias("snps"), arrays.indels(x).cast("long").alias("indels"), F.array_join(arrays.merged_alignment(x), ",").alias("merged"), F.array_join(F.transform(arrays.alignment_flipped(x), lambda c: c["a"]), ",").alias("flipped"), F.array_join(F.transform(arrays.row_indices(x)["a"], lambda i: i.cast("string")), ",").alias("first_row"))


# Arrays.

_FLAGS = ", flags AS (SELECT read_id, list_transform(g, lambda c: CAST(c[1] = '-' AS INT)) AS f FROM lists)"


@query(E3 + ", f AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM calls WHERE gene[1] = '-'), r AS (SELECT read_id, min(pos) AS s, max(pos) AS e FROM f GROUP BY read_id, island) SELECT read_id, arg_min(s, (s - e, s)) AS start, arg_min(e, (s - e, s)) AS \"end\" FROM r GROUP BY read_id")
def longest_covered(spark, sf_dir):
    depths = F.transform("calls", lambda c: c.startswith("-").cast("int") * 3)
    rows = _events(spark, sf_dir).select("read_id", arrays.longest_covered(depths).alias("r")).filter("r is not null")
    return rows.select("read_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


@query(E3 + _LISTS + _FLAGS + " SELECT read_id, array_to_string(list_transform(list_filter(range(1, len(f) + 1), lambda i: f[i] <> 0 OR coalesce(f[i + 1], 0) <> 0), lambda i: f[i]), '') AS kept FROM flags")
def zeros_before_ones(spark, sf_dir):
    flags = F.transform("calls", lambda c: c.startswith("-").cast("int"))
    return _events(spark, sf_dir).select("read_id", F.array_join(F.transform(arrays.with_zero_before(flags), lambda x: x.cast("string")), "").alias("kept"))


@query(E3 + _LISTS + " SELECT read_id, i AS gene, array_to_string(range(greatest(i - 2, 0), least(i, len(g) - 3) + 1), ',') AS nodes FROM lists, unnest(range(0, len(g))) AS t(i) WHERE len(g) >= 3")
def gene_to_nodes(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("size(calls) >= 3").select("read_id", F.posexplode(arrays.gene_to_nodes(F.size("calls") - 2, 3)).alias("gene", "nodes"))
    return rows.select("read_id", F.col("gene").cast("long").alias("gene"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


@query(E3 + _LISTS + " SELECT array_to_string(g[list_position(g, '+view'):], ',') AS suffix, count(DISTINCT read_id) AS n_reads FROM lists WHERE list_position(g, '+view') > 0 AND g[list_position(g, '+view') + 1] IN ('+click', '-view') GROUP BY 1")
def anchor_suffixes(spark, sf_dir):
    walks = _events(spark, sf_dir).select("read_id", F.col("calls").alias("items"))
    hot = spark.sql("SELECT explode(array('+click', '-view')) AS node_id")
    out = paths.anchor_suffixes(walks, "+view", hot)
    return out.select(F.array_join("suffix", ",").alias("suffix"), "n_reads")


@query(E3 + _LISTS + ", p AS (SELECT unnest([['+view', '+click'], ['-click', '+view', '-view']]) AS path) SELECT array_to_string(path, ',') AS path, count(*) AS n_reads FROM lists, p WHERE len(list_filter(range(1, len(g) + 1), lambda i: g[i:i + len(path) - 1] = path OR g[i:i + len(path) - 1] = list_reverse(path))) > 0 GROUP BY path")
def reads_with_path(spark, sf_dir):
    walks = _events(spark, sf_dir).select("read_id", F.col("calls").alias("items"))
    wanted = spark.sql("SELECT explode(array(array('+view', '+click'), array('-click', '+view', '-view'))) AS path")
    return paths.path_support(walks, wanted).select(F.array_join("path", ",").alias("path"), "n_reads")


# Lookups on the graph.


@query(L3 + " SELECT read_id, pos, node_id FROM mers WHERE read_id IN (SELECT read_id FROM calls WHERE gene[2:] = 'Brand#7')")
def nodes_of_reads(spark, sf_dir):
    reads = order_reads(spark, sf_dir)
    hot = reads.filter(F.array_contains(arrays.names(F.col("calls")), "Brand#7")).select("read_id")
    return graph.nodes_of_reads(graph.build_graph(reads, 3), hot).select("read_id", F.col("pos").cast("long").alias("pos"), "node_id")


@query(L3 + " SELECT src, src_dir, tgt, tgt_dir, coverage FROM edges WHERE src_dir = tgt_dir")
def remove_edges(spark, sf_dir):
    g = _orders(spark, sf_dir)
    out = filters.remove_edges(g, g.edges.filter("src_dir <> tgt_dir").select("src", "src_dir", "tgt", "tgt_dir")).edges
    return out.select("src", F.col("src_dir").cast("int").alias("src_dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"), "coverage")


@query(f"SELECT src, src_dir, tgt, tgt_dir, CAST(sum(coverage) AS BIGINT) AS coverage FROM (SELECT * FROM ({E3} SELECT * FROM edges) UNION ALL SELECT * FROM ({L3} SELECT * FROM edges) UNION ALL SELECT * FROM ({E3} SELECT * FROM edges)) GROUP BY ALL")
def merged_edges(spark, sf_dir):
    events = graph.build_graph(_events(spark, sf_dir), 3)
    out = graph.merge_graphs([events, _orders(spark, sf_dir), events]).edges
    return out.select("src", F.col("src_dir").cast("int").alias("src_dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"), "coverage")


@query(f"WITH e AS ({E3}{_LISTS} SELECT read_id, array_to_string(g, ',') AS calls FROM lists), o AS ({L3}{_LISTS} SELECT read_id, array_to_string(g, ',') AS calls FROM lists) SELECT * FROM o UNION ALL SELECT * FROM e WHERE read_id NOT IN (SELECT read_id FROM o)")
def merged_reads(spark, sf_dir):
    """Users and orders share ids; of a read that both graphs have, that of the last one stays."""
    events = graph.build_graph(_events(spark, sf_dir), 3)
    return graph.merge_graphs([events, _orders(spark, sf_dir)]).reads.select("read_id", F.array_join("calls", ",").alias("calls"))


_SUBSET = f", sub AS (SELECT node_id FROM nodes WHERE {_HOT}), se AS (SELECT * FROM edges WHERE src IN (SELECT node_id FROM sub) AND tgt IN (SELECT node_id FROM sub))"


@query(L3 + _SUBSET + " SELECT src, src_dir, tgt, tgt_dir, coverage FROM se")
def subgraph_edges(spark, sf_dir):
    g = _orders(spark, sf_dir)
    out = paths.subgraph_edges(g, filters.nodes_of_interest(g, L1_GENES).select("node_id"))
    return out.select("src", F.col("src_dir").cast("int").alias("src_dir"), "tgt", F.col("tgt_dir").cast("int").alias("tgt_dir"), "coverage")


@query(L3 + _SUBSET + ", n AS (SELECT src, count(DISTINCT tgt) FILTER (WHERE src_dir = 1) AS f, count(DISTINCT tgt) FILTER (WHERE src_dir = -1) AS b FROM se GROUP BY src) SELECT node_id, coalesce(f, 0) = 0 OR coalesce(b, 0) = 0 AS anchor, coalesce(f, 0) > 1 OR coalesce(b, 0) > 1 AS junction FROM sub LEFT JOIN n ON src = node_id")
def subset_anchors(spark, sf_dir):
    g = _orders(spark, sf_dir)
    return paths.subset_anchors(g, filters.nodes_of_interest(g, L1_GENES).select("node_id"))


@query(L3 + ", w AS (SELECT read_id, string_agg(node_id, ',' ORDER BY pos) AS path, avg(coverage) AS coverage FROM mers JOIN nodes USING (node_id) GROUP BY read_id) SELECT DISTINCT path, round(coverage, 6) AS coverage FROM w")
def path_coverage(spark, sf_dir):
    """The mean coverage along the walk of every read."""
    g = _orders(spark, sf_dir)
    walks = graph.walks_of(g).select(F.transform("walk", lambda w: F.struct(w["node_id"].alias("node_id"), w["dir"].cast("int").alias("dir"))).alias("path"))
    return paths.path_coverage(g, walks).select(F.array_join("path.node_id", ",").alias("path"), F.round("coverage", 6).alias("coverage")).distinct()


_SHARED = ", o AS (SELECT DISTINCT read_id, node_id FROM mers), sh AS (SELECT x.node_id AS a, y.node_id AS b, count(*) AS n FROM o x JOIN o y ON x.read_id = y.read_id GROUP BY ALL), num AS (SELECT node_id, row_number() OVER (ORDER BY min({'read_id': read_id, 'pos': pos})) - 1 AS number FROM mers GROUP BY node_id)"


@query(L3 + _SHARED + ", few AS (SELECT num.node_id, number, (SELECT count(*) FROM num) - count(sh.a) AS below FROM num LEFT JOIN sh ON sh.a = num.node_id AND sh.n >= 2 GROUP BY ALL) SELECT node_id FROM few ORDER BY below DESC, number LIMIT 1")
def weakest_node(spark, sf_dir):
    """The one node that shares two reads with the fewest others."""
    g = _orders(spark, sf_dir)
    return filters.weakest_node(filters.shared_reads(g), graph.node_numbers(g), 2)


@query(L3 + _SHARED.replace("sh AS (", "sh AS MATERIALIZED (").replace("num AS (", "num AS MATERIALIZED (") + ", rich AS (SELECT a, count(*) AS n FROM sh WHERE n >= 2 GROUP BY a), w AS MATERIALIZED (SELECT num.node_id FROM num LEFT JOIN rich ON rich.a = num.node_id ORDER BY coalesce(rich.n, 0), number LIMIT 1) SELECT a, b, n FROM sh ANTI JOIN w ON w.node_id = sh.a ANTI JOIN w AS w2 ON w2.node_id = sh.b")
def intersection_filter(spark, sf_dir):
    g = graph.cut_graph(order_reads(spark, sf_dir), 3, edges=False)
    return filters.intersection_filter(filters.shared_reads(g), graph.node_numbers(g), 2)


# Results.


@query("SELECT p_brand AS allele, greatest(1.0, count(*) / 70) AS copy_number FROM part GROUP BY p_brand")
def cluster_copies(spark, sf_dir):
    clusters = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("allele")).agg(F.count("*").alias("n_reads"))
    return stats.cluster_copies(clusters, 70.0)


@query("WITH n AS (SELECT p_brand AS name, l_linenumber AS pos, l_returnflag AS base, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), b AS (SELECT name, pos, arg_min(base, (-n, base)) AS base FROM n GROUP BY name, pos) SELECT name, string_agg(base, '' ORDER BY pos) AS sequence FROM b GROUP BY name")
def consensus(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return results.consensus(rows.select(F.col("p_brand").alias("name"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("base")))


_CHANGED = f"SELECT read_id AS id, list_transform(list_filter(range(1, len(sequence) + 1), lambda i: sequence[i] = 'T'), lambda i: 'T' || (i + 7) || 'A') AS changes FROM ({DNA_SQL.replace('doc_id', 'item_id').replace('documents', 'benchmark')})"


def _changes(spark, sf_dir):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    dna = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), dna.alias("bases")).filter("bases <> ''")
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    cigar = F.array(op(tokens.SOFT_CLIP, F.lit(4)), op(tokens.MATCH, F.length("bases")), op(tokens.HARD_CLIP, F.lit(9)))
    return results.cigar_changes(rows.select("id", cigar.alias("cigar"), F.lit(7).alias("pos"), F.concat(F.lit("GGGGGGG"), "bases").alias("reference"), F.concat(F.lit("CCCC"), F.translate("bases", "T", "A")).alias("query")))


@query(f"SELECT id, array_to_string(changes, ',') AS changes FROM ({_CHANGED})")
def cigar_changes(spark, sf_dir):
    """Every T of the benchmark's sequences as an A, behind seven bases and four clipped ones."""
    return _changes(spark, sf_dir).select("id", F.array_join("changes", ",").alias("changes"))


@query(f"SELECT allele, comments, round(relative_depth, 6) AS relative_depth FROM (SELECT p_brand AS allele, max(p_size) / 50.0 AS relative_depth, '' AS comments FROM part GROUP BY p_brand UNION ALL SELECT id, NULL, array_to_string(changes, ',') FROM ({_CHANGED}) WHERE len(changes) > 0)")
def promoter_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("allele")).agg((F.max("p_size") / 50.0).alias("relative_depth")).withColumn("comments", F.lit(""))
    return results.promoter_rows(_changes(spark, sf_dir), rows).select("allele", "comments", F.round("relative_depth", 6).alias("relative_depth"))


@query("WITH d AS (SELECT p_brand AS allele, count(*) / 80.0 AS relative_depth, count(*) / 40.0 AS copy_number, max(p_size) AS longest_read FROM part GROUP BY p_brand) SELECT DISTINCT p_brand AS allele, p_type AS name, relative_depth, copy_number, longest_read FROM part JOIN d ON p_brand = allele")
def supplement(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "allele")
    depths = part.groupBy("allele").agg((F.count("*") / 80.0).alias("relative_depth"), (F.count("*") / 40.0).alias("copy_number"))
    longest = part.groupBy("allele").agg(F.max("p_size").alias("length"))
    return results.supplement(part.select("allele", F.col("p_type").alias("name")).distinct(), depths, longest)
