"""Functions on arrays of calls and nodes, as higher-order expressions. For alignments of whole columns see ``functions.alignments``."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.tokens import call_name, flip


def _range(first: Column | int, last: Column) -> Column:
    """first .. last, or nothing where last is less; sequence() by itself would count down."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def names(calls: Column) -> Column:
    return F.transform(calls, call_name)


def flipped(calls: Column) -> Column:
    """The calls as the other strand has them: order reversed, strands flipped."""
    return F.transform(F.reverse(calls), flip)


def windows(a: Column, k: int) -> Column:
    """All runs of k elements."""
    return F.transform(_range(0, F.size(a) - k), lambda i: F.slice(a, i + 1, k))


def canonical(win: Column) -> Column:
    """The smaller of a window and its other strand; an odd window never equals it."""
    return F.least(win, flipped(win))


def direction(win: Column) -> Column:
    return F.when(win <= flipped(win), 1).otherwise(-1).cast("tinyint")


def canonical_windows(calls: Column, positions: Column, k: int) -> Column:
    """array<struct<node_id, dir, start, end>> of all windows of k calls; positions may be null.

    The other strand of all calls is made once; that of a window is a slice of it.
    """

    def both(ways: Column) -> Column:
        calls, other, positions = ways["calls"], ways["other"], ways["positions"]
        last = F.size(calls) - k

        def one(i: Column) -> Column:
            win, mirror = F.slice(calls, i + 1, k), F.slice(other, last - i + 1, k)
            return F.struct(F.array_join(F.least(win, mirror), "~~~").alias("node_id"), F.when(win <= mirror, 1).otherwise(-1).cast("tinyint").alias("dir"), F.get(positions, i)["start"].alias("start"), F.get(positions, i + (k - 1))["end"].alias("end"))

        return F.transform(_range(0, last), one)

    return F.transform(F.array(F.struct(calls.alias("calls"), flipped(calls).alias("other"), positions.alias("positions"))), both).getItem(0)


def find_sublist(a: Column, b: Column) -> Column:
    """Starts of all places where b stands in a, with their last index: array<struct<start, end>>."""
    m = F.size(b)
    hit = F.filter(_range(0, F.size(a) - m), lambda i: F.slice(a, i + 1, m) == b)
    return F.when(m > 0, F.transform(hit, lambda i: F.struct(i.alias("start"), (i + m - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def is_sublist(a: Column, b: Column) -> Column:
    m = F.size(b)
    return (m == 0) | F.exists(_range(0, F.size(a) - m), lambda i: F.slice(a, i + 1, m) == b)


def either_way(a: Column, b: Column) -> Column:
    """Whether b stands in a as it is or reversed."""
    return is_sublist(a, b) | is_sublist(a, F.reverse(b))


def all_sublists(a: Column) -> Column:
    n = F.size(a)
    return F.flatten(F.transform(_range(0, n - 1), lambda i: F.transform(_range(1, n - i), lambda m: F.slice(a, i + 1, m))))


def counted(a: Column) -> Column:
    """The different elements of an array and how often each is there: array<struct<value, n>>, in order."""

    def runs_of(x: Column) -> Column:
        starts = F.filter(_range(0, F.size(x) - 1), lambda i: (i == 0) | ~F.get(x, i).eqNullSafe(F.get(x, i - 1)))
        ends = lambda o: F.transform(o, lambda i, j: F.struct(F.get(x, i).alias("value"), (F.coalesce(F.get(o, j + 1), F.size(x)) - i).cast("long").alias("n")))
        return F.flatten(F.transform(F.array(starts), ends))

    return F.flatten(F.transform(F.array(F.array_sort(a)), runs_of))


def smaller_way(a: Column) -> Column:
    return F.least(a, F.reverse(a))


def context_options(a: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """All suffixes of what stands before start, and all prefixes of what follows end; the empty one with both."""
    before = F.transform(_range(0, start), lambda m: F.slice(a, start - m + 1, m))
    after = F.transform(_range(0, F.size(a) - end - 1), lambda m: F.slice(a, end + 2, m))
    return before, after


def runs(flags: Column) -> Column:
    """First and last index of each run of ones: array<struct<start, end>>."""
    one = lambda i: F.coalesce(F.get(flags, i), F.lit(0)) == 1
    last = F.size(flags) - 1
    starts = F.filter(_range(0, last), lambda i: one(i) & ~one(i - 1))
    ends = F.filter(_range(0, last), lambda i: one(i) & ~one(i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def longest_covered(depths: Column) -> Column:
    """The first of the longest runs of non-zero depth."""
    found = runs(F.transform(depths, lambda x: (x > 0).cast("int")))
    best = F.array_max(F.transform(found, lambda r: F.struct((r["end"] - r["start"]).alias("n"), (-r["start"]).alias("at"))))
    return F.when(best.isNotNull(), F.struct((-best["at"]).alias("start"), (best["n"] - best["at"]).alias("end")))


def with_zero_before(a: Column) -> Column:
    """Non-zero elements, and zeros that stand right before one."""
    return F.filter(a, lambda x, i: (x != 0) | (F.coalesce(F.get(a, i + 1), F.lit(0)) != 0))


def turned(nodes: Column, flags: Column, start: Column, end: Column) -> Column:
    """Nodes from start to end, reversed unless the node after start is flagged, and the new bounds."""
    fwd = F.coalesce(F.get(flags, start + 1), F.lit(0)) == 1
    n = F.size(nodes)
    return F.struct(F.when(fwd, nodes).otherwise(F.reverse(nodes)).alias("nodes"), F.when(fwd, start).otherwise(n - 1 - end).alias("start"), F.when(fwd, end).otherwise(n - 1 - start).alias("end"))


def chained_genes(nodes: Column, k: int) -> Column:
    """Calls of a walk, array<struct<genes, dir>>: the first window whole, then the last call of each.

    Nodes without a direction add nothing.
    """
    turned_ = F.transform(F.filter(nodes, lambda n: n["dir"].isNotNull()), lambda n: F.when(n["dir"] == 1, n["genes"]).otherwise(flipped(n["genes"])))
    first = F.coalesce(F.get(turned_, F.lit(0)), F.array().cast("array<string>"))
    return F.concat(first, F.transform(F.slice(turned_, 2, 1 << 30), lambda g: F.get(g, F.lit(k - 1))))


def gene_to_nodes(n_nodes: Column, k: int) -> Column:
    """For each gene of a walk of n nodes, the nodes that cover it."""
    return F.transform(_range(0, n_nodes + (k - 2)), lambda g: _range(F.greatest(g - (k - 1), F.lit(0)), F.least(g, n_nodes - 1)))


def merged_sets(a: Column, b: Column) -> Column:
    """Union of two maps of arrays, by key."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))


# Alignments are array<struct<a, b>>, gaps are *.


def alignment_flipped(aln: Column) -> Column:
    return F.transform(F.reverse(aln), lambda c: F.struct(flip(c["a"]).alias("a"), flip(c["b"]).alias("b")))


def snps(aln: Column) -> Column:
    return F.size(F.filter(aln, lambda c: (c["a"] != c["b"]) & (c["a"] != "*") & (c["b"] != "*")))


def indels(aln: Column) -> Column:
    return F.size(F.filter(aln, lambda c: (c["a"] == "*") != (c["b"] == "*")))


def merged_alignment(aln: Column) -> Column:
    """The second row's calls, the first row's where that has a gap."""
    return F.transform(aln, lambda c: F.when(c["b"] == "*", c["a"]).otherwise(c["b"]))


def row_indices(aln: Column) -> Column:
    """Columns in which each row has no gap: struct<a: array<int>, b: array<int>>."""
    at = _range(0, F.size(aln) - 1)

    def without_gap(row: str) -> Column:
        return F.filter(at, lambda i: F.get(aln, i)[row] != "*").alias(row)

    return F.struct(without_gap("a"), without_gap("b"))


# Plain Python versions of the quadratic ones, for one pair.


def align(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """Global alignment: 1 for equal calls, 0 for others, -1 a gap; the first gap at either border is free.

    Among equally good steps a gap in x goes before a gap in y, and that before a pair.
    """
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    step = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0], step[i][0] = 1 - i, "x"
    for j in range(1, m + 1):
        best[0][j], step[0][j] = 1 - j, "y"
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = ((best[i - 1][j] - 1, 1, "x"), (best[i][j - 1] - 1, 2, "y"), (best[i - 1][j - 1] + (x[i - 1] == y[j - 1]), 0, "xy"))
            best[i][j], _, step[i][j] = max(options)
    out, i, j = [], n, m
    while i or j:
        how = step[i][j]
        out.append((x[i - 1] if "x" in how else "*", y[j - 1] if "y" in how else "*"))
        i, j = i - ("x" in how), j - ("y" in how)
    return out[::-1]


def longest_common_run(a: list, b: list) -> tuple[list, tuple[int, int], tuple[int, int]]:
    """The first of the longest runs that both have, and where it starts and ends in each."""
    best, above = (0, 0, 0), [0] * (len(b) + 1)
    for i in range(len(a)):
        now = [0] * (len(b) + 1)
        for j in range(len(b)):
            if a[i] == b[j]:
                now[j + 1] = above[j] + 1
                if now[j + 1] > best[0]:
                    best = (now[j + 1], i, j)
        above = now
    n, i, j = best
    if not n:
        return [], (0, 0), (0, 0)
    return a[i - n + 1 : i + 1], (i - n + 1, i), (j - n + 1, j)


def spliced(base: list, gaps: dict[tuple[int, int], list[list]]) -> list[list]:
    """``base`` with each gap (start, end, both included) filled by each of its options; none without options."""
    out = []
    order = sorted(gaps)
    for choice in product(*(gaps[g] for g in order)):
        parts, at = [], 0
        for (start, end), fill in zip(order, choice, strict=True):
            parts += base[at:start] + list(fill)
            at = end + 1
        out.append(parts + base[at:])
    return out


def cut_in(nodes: list, dirs: list, replacements: dict[tuple[int, int], list]) -> tuple[list, list]:
    """Nodes with ranges replaced, each range once; the new nodes' directions are not known."""
    out, ways, at = [], [], 0
    for (start, end), new in sorted(replacements.items()):
        out += nodes[at:start] + list(new)
        ways += dirs[at:start] + [None] * len(new)
        at = end + 1
    return out + nodes[at:], ways + dirs[at:]
