"""Sequences of signed symbols made from the driver's tables, and genes of interest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.kmers import bases

E0_GENES = ["error", "purchase"]
L1_GENES = ["Brand#7", "Brand#17"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_calls(rows: DataFrame, read: Column, order: list[str], call: Column) -> DataFrame:
    """Reads from one row per call."""
    item = F.struct(*order, call.alias("call"))
    return rows.groupBy(read.cast("string").alias("read_id")).agg(F.sort_array(F.collect_list(item)).alias("items")).select("read_id", F.col("items.call").alias("calls"))


def event_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read per user, a call per event, in order of time; the strand is the parity of the value."""
    sign = F.when(F.pmod(F.floor("value"), F.lit(2)) == 0, "+").otherwise("-")
    return ordered_calls(table(spark, sf_dir, "events"), F.col("user_id"), ["ts", "event_id"], F.concat(sign, F.col("event_type")))


def order_reads(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """A read per order, a call per line, by the part's brand or type; returned lines are on the other strand.

    Positions follow the calls: ten bases each.
    """
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", symbol), F.col("l_partkey") == F.col("p_partkey"))
    call = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.col(symbol))
    reads = ordered_calls(rows, F.col("l_orderkey"), ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], call)
    return reads.withColumn("positions", F.transform("calls", lambda _, i: F.struct((i * 10).alias("start"), (i * 10 + 9).alias("end"))))


def document_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, sequence): the letters of each document, a to z onto ACGT in turn."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("read_id"), bases(F.lower("text")).alias("sequence"))


# The same as DuckDB SQL, up to the windows of k symbols.


def _windows(calls: str, k: int) -> str:
    win = ", ".join(f"lead(gene, {i}) OVER w" for i in range(k))
    flip = "(CASE WHEN g[1] = '+' THEN '-' ELSE '+' END) || g[2:]"
    return f"""calls AS ({calls}),
raw AS (SELECT read_id, pos, n, [{win}] AS win FROM calls WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
both_ways AS (SELECT read_id, pos, win, list_reverse(list_transform(win, lambda g: {flip})) AS rc FROM raw WHERE pos <= n - {k}),
mers AS (SELECT read_id, pos, array_to_string(CASE WHEN win <= rc THEN win ELSE rc END, '~~~') AS node_id, CASE WHEN win <= rc THEN 1 ELSE -1 END AS dir FROM both_ways),
steps AS (SELECT read_id, pos, node_id AS a, dir AS ad, lead(node_id) OVER w AS b, lead(dir) OVER w AS bd FROM mers WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
mirrored AS (SELECT read_id, pos, 0 AS side, a AS src, ad AS src_dir, b AS tgt, bd AS tgt_dir FROM steps WHERE b IS NOT NULL UNION ALL SELECT read_id, pos, 1, b, -bd, a, -ad FROM steps WHERE b IS NOT NULL),
nodes AS (SELECT node_id, count(*) AS coverage, count(DISTINCT read_id) AS n_reads FROM mers GROUP BY node_id),
edges AS (SELECT src, src_dir, tgt, tgt_dir, count(*) AS coverage FROM mirrored GROUP BY ALL)"""


_E0_CALLS = """SELECT CAST(user_id AS VARCHAR) AS read_id, (CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END) || event_type AS gene,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events"""
_L_CALLS = """SELECT CAST(l_orderkey AS VARCHAR) AS read_id, (CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END) || {symbol} AS gene,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey"""


def event_sql(k: int) -> str:
    return "WITH " + _windows(_E0_CALLS, k)


def order_sql(k: int, symbol: str = "p_brand") -> str:
    return "WITH " + _windows(_L_CALLS.format(symbol=symbol), k)


#: Components of nodes and edges, after ``_windows``; each step only looks at nodes whose label has just fallen.
COMPONENTS_SQL = """, label(node_id, label) USING KEY (node_id) AS (
SELECT node_id, node_id FROM nodes
UNION
SELECT e.tgt, min(c.label) FROM label c JOIN edges e ON e.src = c.node_id JOIN recurring.label r ON r.node_id = e.tgt GROUP BY e.tgt, r.label HAVING min(c.label) < r.label),
first AS (SELECT node_id, min({'read_id': read_id, 'pos': pos}) AS seen FROM mers GROUP BY node_id),
parts AS (SELECT label, row_number() OVER (ORDER BY min(seen), label) AS component FROM label JOIN first USING (node_id) GROUP BY label),
numbered AS (SELECT node_id, component FROM label JOIN parts USING (label))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


DNA_SQL = "SELECT CAST(doc_id AS VARCHAR) AS read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence FROM documents"
