"""Queries on the functions of symbols, arrays and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import alignments, arrays, tokens
from strandloom.operators import sketch, stats
from strandloom.plans.queries import query
from strandloom.plans.sequences import DNA_SQL, document_dna, event_reads, event_sql, order_reads, order_sql, recursive, table

E3, L3 = event_sql(3), order_sql(3)
_LISTS = ", lists AS (SELECT read_id, list(gene ORDER BY pos) AS g FROM calls GROUP BY read_id)"
_FLIP = "list_reverse(list_transform({x}, lambda c: (CASE WHEN c[1] = '+' THEN '-' ELSE '+' END) || c[2:]))"


def _events(spark, sf_dir):
    return event_reads(spark, sf_dir)


@query(E3 + " SELECT read_id, pos, gene[2:] AS name, CASE WHEN gene[1] = '+' THEN 1 ELSE -1 END AS strand FROM calls")
def gene_tokens(spark, sf_dir):
    rows = _events(spark, sf_dir).select("read_id", F.posexplode("calls").alias("pos", "call")).withColumn("c", tokens.split_call(F.col("call")))
    return rows.select("read_id", F.col("pos").cast("long").alias("pos"), "c.name", F.col("c.strand").cast("int").alias("strand"))


@query(E3 + _LISTS + f" SELECT read_id, array_to_string({_FLIP.format(x='g')}, ',') AS flipped FROM lists")
def gene_flip(spark, sf_dir):
    return _events(spark, sf_dir).select("read_id", F.array_join(arrays.flipped(F.col("calls")), ",").alias("flipped"))


@query("SELECT p_partkey, translate(p_brand, '|()-*+#:=/,''', '') AS name FROM part")
def gene_clean(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tokens.clean_name(F.col("p_brand")).alias("name"))


@query("SELECT p_partkey, sha256('\\x80\\x04\\x95'::BLOB || unhex(lpad(hex(strlen(p_brand) + 4), 2, '0')) || unhex('00000000000000') || unhex('8c') || unhex(lpad(hex(strlen(p_brand)), 2, '0')) || encode(p_brand) || unhex('942e')) AS digest FROM part")
def name_digest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tokens.name_digest(F.col("p_brand")).alias("digest"))


@query(f"WITH d AS ({DNA_SQL}) SELECT read_id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc FROM d")
def reverse_complement(spark, sf_dir):
    return document_dna(spark, sf_dir).select("read_id", tokens.reverse_complement(F.col("sequence")).alias("rc"))


@query(E3 + _LISTS + ", p AS (SELECT read_id, i - 1 AS start, i AS \"end\" FROM lists, unnest(range(1, len(g))) AS t(i) WHERE g[i:i + 1] = ['+view', '+click']) SELECT * FROM p")
def sublist_match(spark, sf_dir):
    needle = F.array(F.lit("+view"), F.lit("+click"))
    rows = _events(spark, sf_dir).select("read_id", F.explode(arrays.find_sublist(F.col("calls"), needle)).alias("p"))
    return rows.select("read_id", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("end"))


@query(E3 + _LISTS + " SELECT read_id, array_to_string(g[i:j], ',') AS sub, count(*) AS n FROM lists, unnest(range(1, len(g) + 1)) AS t(i), unnest(range(1, len(g) + 1)) AS u(j) WHERE j >= i GROUP BY ALL")
def sublists(spark, sf_dir):
    subs = F.transform(arrays.all_sublists(F.col("calls")), lambda s: F.array_join(s, ","))
    rows = _events(spark, sf_dir).select("read_id", F.explode(arrays.counted(subs)).alias("s"))
    return rows.select("read_id", F.col("s.value").alias("sub"), "s.n")


@query(E3 + ", f AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM calls WHERE gene[1] = '-') SELECT read_id, min(pos) AS start, max(pos) AS \"end\" FROM f GROUP BY read_id, island")
def runs(spark, sf_dir):
    flags = F.transform("calls", lambda c: c.startswith("-").cast("int"))
    rows = _events(spark, sf_dir).select("read_id", F.explode(arrays.runs(flags)).alias("r"))
    return rows.select("read_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


@query(E3 + _LISTS + f" SELECT read_id, array_to_string(least(g, list_reverse(g)), ',') AS way FROM lists")
def smaller_way(spark, sf_dir):
    return _events(spark, sf_dir).select("read_id", F.array_join(arrays.smaller_way(F.col("calls")), ",").alias("way"))


@query(E3 + _LISTS + " SELECT read_id, 'up' AS side, array_to_string(g[i:2], ',') AS part FROM lists, unnest([1, 2, 3]) AS t(i) WHERE len(g) >= 5 UNION ALL SELECT read_id, 'down', array_to_string(g[5:i], ',') FROM lists, unnest(range(4, len(g) + 1)) AS t(i) WHERE len(g) >= 5")
def context_options(spark, sf_dir):
    up, down = arrays.context_options(F.col("calls"), F.lit(2), F.lit(3))
    rows = _events(spark, sf_dir).filter(F.size("calls") >= 5)
    part = lambda c, side: rows.select("read_id", F.lit(side).alias("side"), F.explode(c).alias("p"))
    return part(up, "up").unionByName(part(down, "down")).select("read_id", "side", F.array_join("p", ",").alias("part"))


@query(E3 + ", s AS (SELECT read_id, pos, n, CASE WHEN gene[2:] <> 'error' THEN pos * 10 END AS s, CASE WHEN gene[2:] <> 'error' THEN pos * 10 + 9 END AS e FROM calls) SELECT read_id, pos, coalesce(s, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start, coalesce(e, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n * 10 - 1)) AS \"end\" FROM s")
def null_fill(spark, sf_dir):
    from strandloom.sources.readers import positions_filled

    rows = _events(spark, sf_dir).select("read_id", F.size("calls").alias("n"), F.posexplode("calls").alias("pos", "call"))
    known = tokens.call_name(F.col("call")) != "error"
    at = F.col("pos").cast("long")
    rows = rows.select("read_id", "n", at.alias("pos"), F.when(known, at * 10).alias("start"), F.when(known, at * 10 + 9).alias("end"))
    return positions_filled(rows, "read_id", "pos", F.col("n") * 10 - 1).select("read_id", "pos", "start", "end")


@query(L3 + ", c AS (SELECT gene[2:] AS name FROM calls) SELECT name, count(*) AS n FROM c GROUP BY name")
def symbol_counts(spark, sf_dir):
    rows = order_reads(spark, sf_dir).select(F.explode(arrays.names(F.col("calls"))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT unnest(range(1, len(sequence) - 13)) AS i, sequence FROM (" + DNA_SQL + ") WHERE len(sequence) >= 15), m AS (SELECT least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT sequence[i:i + 14] AS s FROM k)), c AS (SELECT kmer, count(*) AS n FROM m GROUP BY kmer) SELECT n AS \"count\", count(*) AS n_kmers FROM c GROUP BY n")
def kmer_histogram(spark, sf_dir):
    return stats.count_histogram(stats.kmer_counts(document_dna(spark, sf_dir))).select(F.col("count").cast("long").alias("count"), "n_kmers")


@query("WITH k AS (SELECT unnest(range(1, len(sequence) - 13)) AS i, sequence FROM (" + DNA_SQL + ") WHERE len(sequence) >= 15), m AS (SELECT least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT sequence[i:i + 14] AS s FROM k)), c AS (SELECT kmer, count(*) AS n FROM m GROUP BY kmer) SELECT median(n) AS depth FROM c")
def kmer_median_depth(spark, sf_dir):
    return stats.median_depth(stats.kmer_counts(document_dna(spark, sf_dir)))


_SKETCHES = f"k AS MATERIALIZED (SELECT DISTINCT read_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT read_id, sequence[i:i + 8] AS s FROM ({DNA_SQL}), unnest(range(1, len(sequence) - 7)) AS t(i))), n AS MATERIALIZED (SELECT read_id, n, min(read_id) OVER (PARTITION BY s) AS rep FROM (SELECT read_id, count(*) AS n, string_agg(kmer, '' ORDER BY kmer) AS s FROM k GROUP BY read_id)), met AS MATERIALIZED (SELECT a.read_id AS a, b.read_id AS b, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.read_id < b.read_id GROUP BY ALL), pairs AS MATERIALIZED (SELECT a, b, x.rep AS ra, y.rep AS rb, shared / least(x.n, y.n) AS containment FROM met JOIN n x ON x.read_id = a JOIN n y ON y.read_id = b WHERE shared / least(x.n, y.n) >= {sketch.CLUSTER_CONTAINMENT})"


@query(f"WITH {_SKETCHES} SELECT a, b, round(containment, 6) AS containment FROM pairs")
def containment_pairs(spark, sf_dir):
    return sketch.sequence_containments(document_dna(spark, sf_dir), sketch.CLUSTER_CONTAINMENT).select("a", "b", F.round("containment", 6).alias("containment"))


@query()
def sketch_scaled10(spark, sf_dir):
    return sketch.hashes(document_dna(spark, sf_dir), 11, 10).groupBy("read_id").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_SKETCHES}, link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), label(path_id, cluster) USING KEY (path_id) AS (SELECT read_id, read_id FROM n UNION SELECT l.b, min(c.cluster) FROM label c JOIN link l ON l.a = c.path_id JOIN recurring.label r ON r.path_id = l.b GROUP BY l.b, r.cluster HAVING min(c.cluster) < r.cluster) SELECT path_id, cluster FROM label")
def sketch_clusters(spark, sf_dir):
    return sketch.sequence_clusters(document_dna(spark, sf_dir))


# Cell after cell of each pair's matrix, row by row: score, unequal pairs and gaps on the best way there.
_ALIGNED = """, two AS (SELECT CAST(x.read_id AS BIGINT) AS id, x.g AS a, y.g AS b FROM lists x JOIN lists y ON CAST(y.read_id AS BIGINT) = CAST(x.read_id AS BIGINT) + 1),
cell AS (SELECT id, a, b, len(b) + 1 AS w, [struct_pack(s := 0, snps := 0, indels := 0)] AS c FROM two
UNION ALL SELECT id, a, b, w, list_append(c, CASE
WHEN j = 0 THEN struct_pack(s := 1 - i, snps := 0, indels := i)
WHEN i = 0 THEN struct_pack(s := 1 - j, snps := 0, indels := j)
WHEN c[t].s >= c[t + 1 - w].s AND c[t].s - 1 >= c[t - w].s + same THEN struct_pack(s := c[t].s - 1, snps := c[t].snps, indels := c[t].indels + 1)
WHEN c[t + 1 - w].s - 1 >= c[t - w].s + same THEN struct_pack(s := c[t + 1 - w].s - 1, snps := c[t + 1 - w].snps, indels := c[t + 1 - w].indels + 1)
ELSE struct_pack(s := c[t - w].s + same, snps := c[t - w].snps + 1 - same, indels := c[t - w].indels) END)
FROM (SELECT *, CAST(len(c) AS INT) AS t, CAST(len(c) // w AS INT) AS i, CAST(len(c) % w AS INT) AS j, CASE WHEN a[len(c) // w] = b[len(c) % w] THEN 1 ELSE 0 END AS same FROM cell WHERE len(c) < (len(a) + 1) * w))
SELECT id, c[-1].snps AS snps, c[-1].indels AS indels FROM cell WHERE len(c) = (len(a) + 1) * w"""


@query(recursive(L3) + _LISTS + _ALIGNED)
def alignment(spark, sf_dir):
    """Each order's calls against those of the order with the next key."""
    reads = order_reads(spark, sf_dir).select(F.col("read_id").cast("long").alias("id"), "calls")
    pairs = reads.join(reads.select((F.col("id") - 1).alias("id"), F.col("calls").alias("other")), "id")
    return pairs.select("id", alignments.align_udf("calls", "other").alias("aln")).select("id", arrays.snps(F.col("aln")).alias("snps"), arrays.indels(F.col("aln")).alias("indels"))


@query(L3 + _LISTS + ", two AS (SELECT CAST(x.read_id AS BIGINT) AS id, x.g AS a, y.g AS b FROM lists x JOIN lists y ON CAST(y.read_id AS BIGINT) = CAST(x.read_id AS BIGINT) + 1), part AS (SELECT id, a[i:j] AS run, i, j - i + 1 AS n FROM two, unnest(range(1, len(a) + 1)) AS t(i), unnest(range(1, len(a) + 1)) AS u(j) WHERE j >= i AND len(list_filter(range(1, len(b) + 1), lambda p: b[p:p + j - i] = a[i:j])) > 0), best AS (SELECT id, arg_min(run, (-n, i)) AS run FROM part GROUP BY id) SELECT two.id, coalesce(array_to_string(run, ','), '') AS run FROM two LEFT JOIN best ON two.id = best.id")
def longest_common_run(spark, sf_dir):
    reads = order_reads(spark, sf_dir).select(F.col("read_id").cast("long").alias("id"), "calls")
    pairs = reads.join(reads.select((F.col("id") - 1).alias("id"), F.col("calls").alias("other")), "id")
    return pairs.select("id", alignments.common_run_udf("calls", "other").alias("r")).select("id", F.array_join("r.run", ",").alias("run"))
