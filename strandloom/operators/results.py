"""Closest references, result rows and their filters, and changes told by cigars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.arrays import names
from strandloom.functions.tokens import DELETE, DIFF, EQUAL, HARD_CLIP, INSERT, SOFT_CLIP, cigar_sum

RESULT = (
    "determinant_name string, sequence_name string, closest_reference array<string>, reference_length array<bigint>, identity array<double>, coverage array<double>, "
    "cigar array<string>, allele string, n_reads bigint, relative_depth double, copy_number double, comments string"
)
DEPTH_FOR_FILTER, PARTIAL = 20, 90.0


def closest_alleles(align: DataFrame, refs: DataFrame, required_coverage: float, kind: str = "allele") -> DataFrame:
    """Per reference the best alignment: rname, match, coverage, length, valid and rank.

    match is the share of equal bases: of the reference's length for ``reads``, of the query's for
    ``allele``. coverage is the share of the reference that is aligned. References of enough
    coverage, up to 0.05 less, are valid and come first, by coverage up to 1, match and length;
    the others follow by coverage and match. Equal ones have equal ranks.
    """
    equal = cigar_sum(F.col("cigar"), EQUAL)
    aligned = cigar_sum(F.col("cigar"), 0, EQUAL, DIFF, DELETE)
    query = cigar_sum(F.col("cigar"), 0, INSERT, SOFT_CLIP, HARD_CLIP, EQUAL, DIFF)
    whole = F.col("length") if kind == "reads" else query
    rows = align.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).join(refs, "rname")
    rows = rows.select("rname", "qname", "length", (equal / whole).alias("match"), (aligned / F.col("length")).alias("coverage"))
    best = rows.groupBy("rname", "length").agg(F.max("match").alias("match"), F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("qname")).alias("queries"))
    valid = F.col("coverage") >= max(0.0, required_coverage - 0.05)
    best = best.withColumn("valid", valid)
    order = Window.partitionBy("valid").orderBy(F.desc(F.when(F.col("valid"), F.least(F.lit(1.0), "coverage")).otherwise(F.col("coverage"))), F.desc("match"), F.desc(F.when(F.col("valid"), F.col("length"))))
    return best.withColumn("rank", F.rank().over(order))


def closest_by_allele(align: DataFrame, refs: DataFrame, required_coverage: float) -> DataFrame:
    """(allele, rname, length, identity, coverage, cigar): the closest references of each allele, the query; tied ones are all given.

    Ranked as in ``closest_alleles`` for one allele, but of all alleles at once and within each. Identity and
    coverage are percents. References of enough coverage go before all others.
    """
    equal = cigar_sum(F.col("cigar"), EQUAL)
    aligned = cigar_sum(F.col("cigar"), 0, EQUAL, DIFF, DELETE)
    query = cigar_sum(F.col("cigar"), 0, INSERT, SOFT_CLIP, HARD_CLIP, EQUAL, DIFF)
    rows = align.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).join(refs, "rname")
    text = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), F.substring(F.lit("MIDNSHP=X"), c["op"] + 1, F.lit(1)))), "")
    rows = rows.select(F.col("qname").alias("allele"), "rname", "length", (equal / query).alias("match"), (aligned / F.col("length")).alias("coverage"), identity(F.col("cigar")).alias("identity"), text.alias("cigar"))
    best = rows.groupBy("allele", "rname", "length").agg(F.max(F.struct("match", "coverage", "identity", "cigar")).alias("b"), F.max("coverage").alias("most"))
    best = best.select("allele", "rname", "length", "b.match", "b.identity", "b.cigar", F.col("most").alias("coverage"), (F.col("most") >= max(0.0, required_coverage - 0.05)).alias("valid"))
    score = F.when(F.col("valid"), F.least(F.lit(1.0), "coverage")).otherwise(F.col("coverage"))
    order = Window.partitionBy("allele").orderBy(F.desc("valid"), F.desc(score), F.desc("match"), F.desc(F.when(F.col("valid"), F.col("length"))))
    found = best.withColumn("rank", F.rank().over(order)).filter("rank = 1")
    return found.select("allele", "rname", "length", "identity", (F.least(F.lit(1.0), "coverage") * 100).alias("coverage"), "cigar")


def identity(cigar: Column) -> Column:
    """Equal bases over all that isn't clipped, in percent."""
    return 100.0 * cigar_sum(cigar, EQUAL) / cigar_sum(cigar, 0, INSERT, DELETE, EQUAL, DIFF)


def result_rows(best: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """One row per allele of best (allele, rname, length, identity, coverage, cigar, n_reads), tied references together."""
    told = best.join(phenotypes.select(F.col("allele").alias("rname"), "phenotype"), "rname", "left")
    item = F.struct("rname", "length", "identity", "coverage", "cigar", "phenotype")
    rows = told.groupBy("allele", "n_reads").agg(F.array_sort(F.collect_set(item)).alias("x"))
    one = F.get("x", F.lit(0))
    return rows.select(one["rname"].alias("determinant_name"), one["phenotype"].alias("sequence_name"), F.col("x.rname").alias("closest_reference"), F.col("x.length").alias("reference_length"), F.col("x.identity").alias("identity"), F.col("x.coverage").alias("coverage"), F.col("x.cigar").alias("cigar"), "allele", F.col("n_reads"))


def supplement(results: DataFrame, depths: DataFrame, longest: DataFrame | None = None) -> DataFrame:
    """Results with relative depth and copy number of each allele, and its longest read if given; a missing allele is an error."""
    rows = results.join(depths.select("allele", "relative_depth", "copy_number", F.lit(1).alias("there")), "allele", "left")
    missing = F.raise_error(F.concat(F.lit("no depth for "), F.col("allele"))).cast("int")
    rows = rows.filter(F.when(F.col("there") == 1, 1).otherwise(missing) == 1).drop("there")
    return rows.join(longest.select("allele", F.col("length").alias("longest_read")), "allele", "left") if longest is not None else rows


def first_value(column: Column, kind: str) -> Column:
    """The first of tied values: of an array, or of a text with slashes."""
    if kind.startswith("array"):
        return F.get(column, F.lit(0)).cast("double")
    return F.get(F.split(column.cast("string"), "/"), F.lit(0)).cast("double")


def filter_results(results: DataFrame, alleles: DataFrame, reads: DataFrame, genes: list[str], identity: float, coverage: float, depth: float, mean_depth: float, meta: bool = False) -> DataFrame:
    """Results that are similar, covered and deep enough, with comments.

    identity and coverage are shares, the columns percents. Depth doesn't count in metagenomes or
    at a mean depth under 20. An allele is a potential contaminant if all of its reads have
    nothing but genes of interest. alleles: allele, read_id; reads: read_id, calls.
    """
    kinds = dict(results.dtypes)
    same, cover = first_value(F.col("identity"), kinds["identity"]), first_value(F.col("coverage"), kinds["coverage"])
    keep = (same >= identity * 100) & (cover >= coverage * 100)
    if not meta and mean_depth >= DEPTH_FOR_FILTER:
        keep = keep & (F.col("relative_depth") >= depth)
    wanted = F.array(*map(F.lit, genes)).cast("array<string>")
    only = alleles.select("allele", "read_id").distinct().join(reads.select("read_id", (F.size(F.array_except(names(F.col("calls")), wanted)) == 0).alias("only")), "read_id").groupBy("allele").agg(F.min(F.col("only").cast("int")).alias("only"))
    rows = results.filter(keep).join(only, "allele", "left")
    flags = F.concat_ws(" ", F.when(cover < PARTIAL, "Partially present gene."), F.when(F.col("only") == 1, "Potential contaminant."))
    return rows.withColumn("comments", flags).drop("only")


def cigar_changes(rows: DataFrame) -> DataFrame:
    """Rows (id, cigar, pos from 0, reference, query) with the array of their changes in order.

    A12T is a substitution, 12IAC an insertion behind base 12, 12-14D a deletion of these bases;
    places are counted from 1 on the reference.
    """
    zero = F.struct(F.col("pos").cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        n, op = c["len"], c["op"]
        base = lambda s, at: F.substr(F.col(s), at + 1, F.lit(1))
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(base("reference", acc["r"] + i), (acc["r"] + i + 1).cast("string"), base("query", acc["q"] + i)))
        changed = F.filter(pairs, lambda p: F.substring(p, 1, 1) != F.substring(p, -1, 1))
        inserted = F.array(F.concat(acc["r"].cast("string"), F.lit("I"), F.substr(F.col("query"), acc["q"] + 1, n)))
        deleted = F.array(F.concat((acc["r"] + 1).cast("string"), F.lit("-"), (acc["r"] + n).cast("string"), F.lit("D")))
        none = F.array().cast("array<string>")
        new = F.when(op.isin(0, EQUAL, DIFF), changed).when(op == INSERT, inserted).when(op == DELETE, deleted).otherwise(none)
        on_r = F.when(op.isin(0, DELETE, 3, EQUAL, DIFF), n).otherwise(0)
        on_q = F.when(op.isin(0, INSERT, SOFT_CLIP, EQUAL, DIFF), n).otherwise(0)
        return F.struct((acc["r"] + on_r).cast("int").alias("r"), (acc["q"] + on_q).cast("int").alias("q"), F.concat(acc["out"], new).alias("out"))

    return rows.select("id", F.aggregate("cigar", zero, step, lambda acc: acc["out"]).alias("changes"))


def promoter_rows(changes: DataFrame, results: DataFrame) -> DataFrame:
    """Results with a row more for each promoter allele (id) that has changes; columns it lacks are null."""
    rows = changes.filter(F.size("changes") > 0).select(F.col("id").alias("allele"), F.array_join("changes", ",").alias("comments"))
    return results.unionByName(rows, allowMissingColumns=True)


def consensus(bases: DataFrame) -> DataFrame:
    """(name, sequence): the most frequent base at each place of bases (name, pos, base); the least of equal ones."""
    n = bases.groupBy("name", "pos", "base").agg(F.count("*").alias("n"))
    best = n.groupBy("name", "pos").agg(F.min(F.struct((-F.col("n")).alias("less"), "base")).alias("b"))
    return best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("b.base").alias("base")))).alias("x")).select("name", F.array_join("x.base", "").alias("sequence"))


def external(rows: DataFrame, run, schema: str) -> DataFrame:
    """The place for outside tools (mapping, polishing, assembly): ``run`` gets pandas frames of a partition's rows."""
    return rows.mapInPandas(run, schema)
