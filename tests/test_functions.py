import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import arrays as A
from strandloom.functions.alignments import align_udf
from strandloom.functions import tokens as T
from strandloom.operators.correct import filled


def one(spark, expr, **values):
    kinds = {list: "array<string>", str: "string", int: "int"}
    row = spark.range(1).select(*(F.from_json(F.lit(json.dumps(v)), kinds[type(v)]).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


def test_calls(spark):
    c = F.col("c")
    assert tuple(one(spark, T.split_call(c), c="-gene A")) == ("gene_A", -1)
    assert one(spark, T.flip(c), c="+a") == "-a" and one(spark, T.flip(c), c="*") == "*" and one(spark, T.flip(c), c="x") is None
    assert one(spark, T.clean_name(c), c="a|(b)-c*'d") == "abcd"
    assert one(spark, T.reverse_complement(c), c="AACG") == "CGTT"
    for bad in ("gene", "+", ""):
        with pytest.raises(Exception, match="strand"):
            one(spark, T.split_call(c), c=bad)
    with pytest.raises(Exception, match="strand"):
        one(spark, T.strand_to_int(c), c="x")


def test_name_digest_is_that_of_the_pickled_name(spark):
    import hashlib
    import pickle

    for name in ("gene1", "é", "a" * 200):
        assert one(spark, T.name_digest(F.col("c")), c=name) == hashlib.sha256(pickle.dumps(name, protocol=4)).hexdigest()


def test_cigars(spark):
    cigar = T.parse_cigar(F.col("c"))
    assert one(spark, T.region_start(cigar), c="5H10M2D3I") == 4
    assert one(spark, T.region_length(cigar), c="5H10M2D3I4H") == 15
    assert one(spark, T.region_end(cigar, F.lit(0)), c="10M") == 9
    assert one(spark, T.mapped_call(F.col("c"), F.lit(16)), c="a~~~b.aln.fas") == "-a;b"


def test_windows(spark):
    a = F.col("a")
    win = ["-g3", "+g2", "-g1"]
    assert one(spark, A.flipped(a), a=win) == ["+g1", "-g2", "+g3"]
    assert one(spark, A.canonical(a), a=win) == ["+g1", "-g2", "+g3"]
    assert one(spark, A.direction(a), a=win) == -1
    assert one(spark, A.windows(a, 3), a=["a", "b"]) == []
    assert one(spark, A.windows(a, 2), a=["a", "b", "c"]) == [["a", "b"], ["b", "c"]]


def test_sublists(spark):
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in one(spark, A.find_sublist(a, b), a=list("abab"), b=list("ab"))] == [(0, 1), (2, 3)]
    assert one(spark, A.is_sublist(a, b), a=list("abc"), b=[]) is True
    assert one(spark, A.is_sublist(a, b), a=list("ab"), b=list("abc")) is False
    assert len(one(spark, A.all_sublists(a), a=list("abc"))) == 6
    up, down = A.context_options(a, F.lit(1), F.lit(2))
    assert one(spark, up, a=list("abcd")) == [[], ["a"]] and one(spark, down, a=list("abcd")) == [[], ["d"]]
    flags = F.array(*map(F.lit, (0, 1, 1, 0, 1)))
    assert [tuple(r) for r in one(spark, A.runs(flags), a="x")] == [(1, 2), (4, 4)]
    assert tuple(one(spark, A.longest_covered(flags), a="x")) == (1, 2)
    assert one(spark, A.with_zero_before(flags), a="x") == [0, 1, 1, 0, 1]


def test_alignment():
    assert A.align(["+1", "-2", "+3"], ["+1", "+3"]) == [("+1", "+1"), ("-2", "*"), ("+3", "+3")]
    x, y = list("abcdef"), list("uvwxef")
    assert A.align(x, y) == list(zip(x, y, strict=True))
    assert A.longest_common_run(list("abcdef"), list("xyzabcd"))[0] == list("abcd")


def test_alignment_functions(spark):
    rows = spark.createDataFrame([(["+1", "-2", "+3"], ["+1", "+3"])], "x array<string>, y array<string>")
    got = rows.select(align_udf("x", "y").alias("a")).select(A.snps(F.col("a")), A.indels(F.col("a")), A.merged_alignment(F.col("a")), A.alignment_flipped(F.col("a"))).first()
    assert (got[0], got[1], got[2]) == (0, 1, ["+1", "-2", "+3"])
    assert [tuple(c) for c in got[3]] == [("-3", "-3"), ("+2", "*"), ("-1", "-1")]


def test_splices():
    base = list("abcdefg")
    out = A.spliced(base, {(1, 2): [["x"], ["y"]], (4, 5): [["p"], ["q", "r"]]})
    assert len(out) == 4 and list("axdpg") in out and list("aydqrg") in out
    assert A.spliced(base, {(1, 2): []}) == [] and A.spliced(base, {}) == [base]
    assert A.cut_in(list("abc"), [1, 1, 1], {(1, 1): ["x", "y"]}) == (list("axyc"), [1, None, None, 1])


NONE = (None, None)


def brute_filled(places, last_base):
    """Each unknown place looks left for a known end and right for a known start by itself."""
    out = []
    for i, p in enumerate(places):
        before = next((e for _, e in reversed(places[:i]) if e is not None), 0)
        after = next((s for s, _ in places[i + 1 :] if s is not None), last_base)
        out.append(p if p != NONE else (before, after))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=12), st.integers(100, 200))
def test_unknown_places_are_filled_from_their_neighbours(known, last_base):
    places = [(7 * i, 7 * i + 4) if k else NONE for i, k in enumerate(known)]
    assert filled(places, last_base) == brute_filled(places, last_base)


calls = st.lists(st.sampled_from([s + n for s in "+-" for n in "abc"]), max_size=12)


@settings(max_examples=60, deadline=None)
@given(calls, calls)
def test_alignment_keeps_both_rows(x, y):
    aln = A.align(x, y)
    assert [a for a, _ in aln if a != "*"] == x and [b for _, b in aln if b != "*"] == y
