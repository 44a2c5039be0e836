"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling, that scores every text.

Every token is drawn in the restaurant of its context, the word before. All contexts share the
root, and the root's base is uniform over the training vocabulary and one unknown word. Tables
of a restaurant are customers of its parent. There are as many restaurants as the corpus has
words; words and contexts are told by 64-bit hashes.

Texts are read in blocks. Each block sends its distinct pairs (word, context) with their counts
to the partition of the word, and keeps which of its rows the pairs are of as a home row; both
are checkpointed. A partition seats all pairs of its words. What it needs from others are the
totals of the contexts that it meets: it sends its own part to the owner of each context and
gets the sums back, before the first sweep and after each. A sweep draws anew, for
each restaurant and dish, the number of tables from its exact conditional given everything else,
by generalised Stirling numbers; those of dishes of over ``STIRLING`` customers come from an
integral instead of a table. The first ``BURN_IN`` sweeps are not used; the predictive
probabilities of the later ones are averaged, each with the totals of its own seating, and go
back to the home rows, which sum them up.

Words of over a share of 1 / ``HEAVY`` of all training tokens (2 * ``HEAVY`` words at most) are
frequent: their pairs are spread over the partitions by word and context, so that no partition
gets a hot word; the partitions' sums of their tables are seated in the root on the driver, as
one more partition of bounded size; and messages name them by two bytes. Any other word brings at
most a share of 1 / ``HEAVY`` of the tokens into its partition. Random numbers are
seeded by partition and sweep, so scores don't depend on how the input is split.

Null and empty texts are the end token alone. Very long texts are blocks of their own. Repeated
rows count and are scored as often as they come. Rows with null doc_ids train and are not held
out. Without training tokens all counts are zero and the score is that of the base. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import CLEAN, checkpointed, dropped, ready_for_checkpoints, settings, stored, worker_cache

HEAVY = 32767
DISCOUNT = (0.75, 0.6)
STRENGTH = (1.0, 20.0)
SWEEPS, BURN_IN = 4, 1
STIRLING = 128
FLUSH_CHARS = 6 << 20
LEAST_PARTITIONS, TOKENS_EACH = 96, 2_000_000
#: So many bytes of text count as a token at least.
BYTES_A_TOKEN = 12
END, SEED = b"\n", 7
ESCAPE = 65535

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Block:
    """Tokens of some consecutive rows: codes into ``hashes``, codes of the words before, and the row each is of."""

    def __init__(self, texts: list[str]):
        raw = pa.array([t.encode().translate(_TABLE) for t in texts], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(raw)
        flat, ends = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
        coded = flat.dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(ends))
        if b"" in words:  # white space at either end
            blank = code != words.index(b"")
            code, row = code[blank], row[blank]
        words.append(END)
        per = np.bincount(row, minlength=len(texts))
        place = np.cumsum(per + 1) - 1
        self.code = np.full(len(code) + len(texts), len(words) - 1, np.int64)
        keep = np.ones(len(self.code), bool)
        keep[place] = False
        self.code[keep] = code
        self.row = np.repeat(np.arange(len(texts)), per + 1)
        self.n = per + 1
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.before = np.r_[len(words) - 1, self.code[:-1]]  # the end token of the text before stands for the start


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Blocks of bounded size of (row, doc_id, text, learns), with their rows."""
    worker_cache("pitman_yor")
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= FLUSH_CHARS or i + 1 == len(texts) or i + 1 - at == 60_000:
                yield Block(texts[at : i + 1]), batch.slice(at, i + 1 - at)
                at, size = i + 1, 0


def _learning(rows: pa.RecordBatch) -> np.ndarray:
    return np.asarray(rows.column(3).to_numpy(zero_copy_only=False), bool)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the training tokens, under hash 0, and the words that may be frequent."""
    for block, rows in _blocks(batches):
        n = np.bincount(block.code[_learning(rows)[block.row]], minlength=len(block.hashes))
        often = np.flatnonzero(n * HEAVY * 2 >= n.sum()) if n.sum() else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.uint64(0), block.hashes[often]].view(np.int64)), pa.array(np.r_[n.sum(), n[often]])], ["hash", "n"])


# Arrays as bytes.


def _packed(x: np.ndarray, kind) -> bytes:
    """Compressed, the lowest bytes of all numbers first, then the next ones."""
    raw = np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpacked(x: bytes, kind) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    raw = np.frombuffer(pa.decompress(x[8:], n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _place(book: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted book, or ``ESCAPE``."""
    if not len(book):
        return np.full(len(hashes), ESCAPE)
    at = np.minimum(np.searchsorted(book, hashes), len(book) - 1)
    return np.where(book[at] == hashes, at, ESCAPE)


def _named(place: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes]:
    return _packed(place, np.uint16), hashes[place == ESCAPE].tobytes()


def _hashes(place: bytes, rest: bytes, book: np.ndarray) -> np.ndarray:
    at = _unpacked(place, np.uint16)
    out = np.empty(len(at), np.uint64)
    out[at == ESCAPE] = np.frombuffer(rest, np.uint64)
    out[at != ESCAPE] = book[at[at != ESCAPE]]
    return out


def _owner(hashes: np.ndarray, partitions: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(partitions)).astype(np.int64)


_ROUTED = ("kind", "part", "first", "words", "words_rest", "pairs", "contexts", "contexts_rest", "trained", "doc_ids")


def _routed(book: np.ndarray, partitions: int):
    """Each block's pairs by the partition of their word (kind 0), and its home row (kind 1).

    A home row has the rows of its tokens and how often each pair comes, both in the order of the
    pairs over all partitions, and the ids and tokens of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            first, size = rows.column(0)[0].as_py(), len(block.hashes)
            key, of, tokens = np.unique(block.code * size + block.before, return_inverse=True, return_counts=True)
            trained = np.bincount(of, _learning(rows)[block.row], len(key)).astype(np.int64)
            word, context = np.divmod(key, size)
            place = _place(book, block.hashes)
            mixed = block.hashes[word] ^ np.where(place[word] == ESCAPE, np.uint64(0), block.hashes[context] * np.uint64(0x9E3779B97F4A7C15))
            part = _owner(mixed, partitions)
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            of_row = block.row[np.argsort(rank[of], kind="stable")]
            ids = rows.column(1)
            home = (1, first % partitions, first, _packed(of_row, np.uint16), b"", _packed(tokens[order], np.uint32), _packed(block.n, np.uint32), b"", b"")
            word, context, trained = word[order], context[order], trained[order]
            bounds = np.searchsorted(part[order], np.arange(partitions + 1))
            out = [home]
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[p], bounds[p + 1]
                at = np.flatnonzero(np.r_[True, word[a + 1 : b] != word[a : b - 1]])
                uniq, u = word[a:b][at], context[a:b]
                out.append((0, p, first, *_named(place[uniq], block.hashes[uniq]), _packed(np.diff(np.r_[at, b - a]), np.uint32), *_named(place[u], block.hashes[u]), _packed(trained[a:b], np.uint32)))
            kinds = (pa.int32(), pa.int32(), pa.int64(), *(pa.binary(),) * 6)
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(out), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([*columns, lists], _ROUTED)

    return run


def _predictive(c, t, level: int, customers, tables, parent):
    d, s = DISCOUNT[level], STRENGTH[level]
    return (c - d * t + (s + d * tables) * parent) / (s + customers)


@dataclass
class Root:
    """The root's totals over all partitions, and its dishes of frequent words."""

    customers: float
    tables: float
    distinct: int
    c: np.ndarray
    t: np.ndarray

    @property
    def base(self) -> float:
        return 1.0 / (self.distinct + 1)


class Seating:
    """The restaurants' dishes of some words, and the root's dishes of those that are no frequent ones."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, place: np.ndarray):
        """Distinct pairs with their customers; ``place`` of each word among the frequent ones, or ``ESCAPE``."""
        self.word, self.context, self.c, self.place = word, context, count.astype(np.int64), place
        self.own = place == ESCAPE
        self.t = np.ones(len(word), np.int64)
        self.root_t = np.minimum(self.root_c, 1)

    @property
    def root_c(self) -> np.ndarray:
        return np.bincount(self.word, self.t, len(self.place)).astype(np.int64)

    def root(self, root: Root) -> np.ndarray:
        """The root's probability of every word."""
        c, t = self.root_c, self.root_t.copy()
        shared = ~self.own
        c[shared], t[shared] = root.c[self.place[shared]], root.t[self.place[shared]]
        return _predictive(c, t, 1, root.customers, root.tables, root.base)

    def sweep(self, tables: np.ndarray, root: Root, rng: np.random.Generator) -> None:
        """tables: of each context, over all partitions, before this sweep."""
        self.t = _tables(self.c, self.t, 0, tables[self.context], self.root(root)[self.word], rng)
        c = self.root_c
        eaten = np.flatnonzero((c > 0) & self.own)
        self.root_t = np.minimum(self.root_t, c)
        self.root_t[eaten] = _tables(c[eaten], self.root_t[eaten], 1, np.full(len(eaten), root.tables), np.full(len(eaten), root.base), rng)

    def probabilities(self, word, context, c, t, customers: np.ndarray, tables: np.ndarray, root: Root) -> np.ndarray:
        """Of pairs that c customers at t tables have eaten, or none; customers and tables of each context."""
        return _predictive(c, t, 0, customers[context], tables[context], self.root(root)[word])


_stirling: dict[int, np.ndarray] = {}


def stirling(level: int) -> np.ndarray:
    """log S(c, t): the seatings of c customers at t tables, weighted by the discount."""
    if level not in _stirling:
        d, out = DISCOUNT[level], np.full((STIRLING + 1, STIRLING + 1), -np.inf)
        out[1, 1] = 0.0
        for c in range(1, STIRLING):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - t * d, 0)) + out[c, t])
        _stirling[level] = out
    return _stirling[level]


def _tables(c: np.ndarray, t: np.ndarray, level: int, tables: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw of the tables of each dish given the tables of all other dishes of its restaurant."""
    d, s = DISCOUNT[level], STRENGTH[level]
    out = np.minimum(c, 1)
    others = np.maximum(tables - t, 0.0)
    many = np.flatnonzero(c > 1)
    order = many[np.argsort(c[many], kind="stable")]
    size = c[order]
    at = 0
    small = int(np.searchsorted(size, STIRLING, side="right"))
    while at < small:
        # Dishes of about equal size together, as one matrix over the possible numbers of tables.
        top = int(size[at])
        stop = min(int(np.searchsorted(size, top + top // 8, side="right")), small, at + 200_000)
        i, width = order[at:stop], int(size[stop - 1])
        new = np.log(s + d * (others[i][:, None] + np.arange(width))) + np.log(parent[i])[:, None]
        logp = stirling(level)[c[i], 1 : width + 1] + np.cumsum(new, axis=1)
        p = np.cumsum(np.exp(logp - logp.max(axis=1, keepdims=True)), axis=1)
        out[i] = 1 + np.minimum((p < (rng.random(len(i)) * p[:, -1])[:, None]).sum(axis=1), c[i] - 1)
        at = stop
    i = order[small:]
    if len(i):
        out[i] = _many_tables(c[i], level, others[i], parent[i], rng)
    return out


def _bisected(f, low: float, high: float, n: int) -> np.ndarray:
    """Where the falling ``f`` of the logarithm is 0, for each of n."""
    a, b = np.full(n, low), np.full(n, high)
    for _ in range(44):
        mid = (a + b) / 2
        up = f(np.exp(mid)) > 0
        a, b = np.where(up, mid, a), np.where(up, b, mid)
    return np.exp((a + b) / 2)


def _slope(x: np.ndarray, d: float):
    """f = 1 - (1 - exp(-x)) ** d and -f' / f."""
    log = np.log(-np.expm1(-x))
    f = -np.expm1(d * log)
    return f, d * np.exp((d - 1) * log - x) / f


def log_stirling(c: np.ndarray, t: np.ndarray, steps: int, d: float) -> np.ndarray:
    """log(S(c, t + k) * (t + k)! * d ** (t + k) / c!) for k under ``steps``, one row for each c and t.

    The generating function of S(., t) is ((1 - (1 - x) ** d) / d) ** t / t!. With x = exp(-z) its
    coefficient is an integral over a contour around the cut z <= 0: a parabola, or a straight
    line where the saddle is far from the cut. Both pass the saddle of the middle t, so nothing
    large cancels and 40 points give about ten digits.
    """
    c = c.astype(float)
    z = _bisected(lambda x: _slope(x, d)[1] - c / np.minimum(t + (steps - 1) / 2, c), -80, 3.0, len(c))
    u = (np.arange(40) + 0.5) / 40
    near = z < 0.5
    top = np.maximum(z, 3 / c)
    span = np.sqrt(80 / (c * top))[:, None]
    v = span * u
    bent = top[:, None] * (1 + 1j * v) ** 2
    low, high = _slope(z * 0.99, d)[1], _slope(z * 1.01, d)[1]
    curve = np.maximum((low - high) / (0.02 * z) * t, 1e-12)
    reach = np.minimum(np.pi, 14 / np.sqrt(curve))[:, None]
    at = np.where(near[:, None], bent, z[:, None] + 1j * reach * u)
    weight = np.where(near[:, None], top[:, None] * 2 * (1 + 1j * v) * span, reach) / (np.pi * 40)
    f = -np.expm1(d * np.log(-np.expm1(-at)))
    log = c[:, None] * at + t[:, None] * np.log(f)
    most = log.real.max(axis=1)
    g, out = np.exp(log - most[:, None]) * weight, np.empty((len(c), steps))
    for k in range(steps):
        out[:, k] = g.real.sum(axis=1)
        g *= f
    return np.log(np.maximum(out, 1e-300)) + most[:, None]


def _law(c: np.ndarray, low: np.ndarray, high: np.ndarray, d: float, a: np.ndarray, parent: np.ndarray):
    """Dish, tables and log weight for all numbers of tables from low to high, and where each dish begins."""
    n = high - low + 1
    starts = np.cumsum(n) - n
    of = np.repeat(np.arange(len(c)), n)
    t = np.arange(len(of)) - starts[of] + low[of]
    logp = np.cumsum(np.log((a[of] + t - 1) / t * parent[of]))
    logp -= logp[starts][of]
    # Where tables are about as many as customers, the integrand changes faster with t.
    for steps, dense in ((16, False), (4, True)):
        mine = np.flatnonzero((high * 2 > c) == dense)
        per = -(-n[mine] // steps)
        panel, dish = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per), np.repeat(mine, per)
        for x in range(0, len(dish), 2048):
            i, p = dish[x : x + 2048], panel[x : x + 2048]
            s = log_stirling(c[i], low[i] + p * steps, steps, d)
            k = p[:, None] * steps + np.arange(steps)
            inside = k < n[i][:, None]
            logp[(starts[i][:, None] + k)[inside]] += s[inside]
    return of, t, logp, starts


def _many_tables(c: np.ndarray, level: int, others: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws from the same conditional for dishes of many customers, over the tables that have weight.

    The weights are log-concave in t (a is over 1), so beyond a bound where they are under
    exp(-30) of the largest they fall at least as fast as on the way there; the range is
    doubled until both its ends are that low, or are the ends of the law.
    """
    d, out = DISCOUNT[level], np.zeros(len(c), np.int64)
    a = (STRENGTH[level] + d * others) / d
    parent = np.minimum(parent, 1.0)

    def missing(x: np.ndarray) -> np.ndarray:
        f, slope = _slope(x, d)
        return a * parent * f * slope / np.maximum(1 - parent * f, 1e-300) - c

    x = _bisected(missing, -80, 3.0, len(c))
    f = _slope(x, d)[0]
    middle = np.clip(a * parent * f / np.maximum(1 - parent * f, 1e-300), 1, c)
    width = 10 * np.sqrt(middle) + 16
    left = np.argsort(middle, kind="stable")
    while len(left):
        # As many dishes at once as have 200000 weights.
        room = np.cumsum(2 * width[left])
        i = left[: max(1, int(np.searchsorted(room, 200_000)))]
        low = np.clip(np.floor(middle[i] - width[i]), 1, c[i]).astype(np.int64)
        high = np.clip(np.ceil(middle[i] + width[i]), low, c[i]).astype(np.int64)
        of, t, logp, starts = _law(c[i], low, high, d, a[i], parent[i])
        most, last = np.maximum.reduceat(logp, starts), np.r_[starts[1:], len(of)] - 1
        fine = ((low == 1) | (logp[starts] < most - 30)) & ((high == c[i]) | (logp[last] < most - 30))
        p = np.cumsum(np.exp(logp - most[of]))
        before = np.r_[0.0, p][starts]
        k = np.searchsorted(p, before + rng.random(len(i)) * (p[last] - before), side="right")
        drawn = t[np.clip(k, starts, last)]
        out[i[fine]] = drawn[fine]
        width[i[~fine]] *= 2
        left = np.r_[left[len(i) :], i[~fine]]
    return out


class _Part:
    """The pairs of one partition, from the messages of all blocks. Nothing depends on their order but ``pairs``."""

    def __init__(self, messages: pa.Table, book: np.ndarray, partitions: int):
        worker_cache("pitman_yor")
        rows = messages.select(_ROUTED[1:9]).to_pylist()
        self.part = rows[0]["part"]
        words = [_hashes(r["words"], r["words_rest"], book) for r in rows]
        per = [_unpacked(r["pairs"], np.uint32) for r in rows]
        contexts = [_hashes(r["contexts"], r["contexts_rest"], book) for r in rows]
        self.blocks = [(r["first"], len(c)) for r, c in zip(rows, contexts, strict=True)]
        trained = np.concatenate([_unpacked(r["trained"], np.uint32) for r in rows])
        hashes, word = np.unique(np.concatenate(words), return_inverse=True)
        self.contexts, context = np.unique(np.concatenate(contexts), return_inverse=True)
        key, self.pairs = np.unique(np.repeat(word, np.concatenate(per)) * len(self.contexts) + context, return_inverse=True)
        self.word, self.context = np.divmod(key, len(self.contexts))
        self.count = np.bincount(self.pairs, trained, len(key)).astype(np.int64)
        self.eaten = np.flatnonzero(self.count)
        self.seating = Seating(self.word[self.eaten], self.context[self.eaten], self.count[self.eaten], _place(book, hashes))
        owner = _owner(self.contexts, partitions)
        self.order = np.argsort(owner, kind="stable")
        self.bounds = np.searchsorted(owner[self.order], np.arange(partitions + 1))

    def restore(self, state: dict) -> None:
        s = self.seating
        s.t[s.c > 1] = _unpacked(state["b"], np.uint32)
        s.root_t = _unpacked(state["c"], np.uint32).astype(np.int64)

    def totals(self, sums: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context, from the rows of their owners."""
        sums = sorted(sums, key=lambda r: r["to"])
        out = np.zeros((2, len(self.contexts)), np.int64)
        for x, name in zip(out, "bc", strict=True):
            x[self.order] = np.concatenate([_unpacked(r[name], np.uint32) for r in sums])
        return out[0], out[1]

    def told(self, sweep: int) -> pa.Table:
        """What this partition has for the owners of contexts (kind 0), for the root (1) and for itself (2)."""
        s, n = self.seating, len(self.contexts)
        c = np.bincount(s.context, s.c, n).astype(np.int64)[self.order]
        t = np.bincount(s.context, s.t, n).astype(np.int64)[self.order]
        hashes, out = self.contexts[self.order], []
        for q in np.flatnonzero(np.diff(self.bounds)).tolist():
            a, b = self.bounds[q], self.bounds[q + 1]
            out.append((0, sweep, q, self.part, hashes[a:b].tobytes(), _packed(c[a:b], np.uint32), _packed(t[a:b], np.uint32)))
        frequent, root_c = np.flatnonzero(~s.own), s.root_c
        size = int(ESCAPE)
        count = np.bincount(s.word, s.c, len(s.place))[frequent]
        at = np.r_[s.place[frequent], size + s.place[frequent], 2 * size, 2 * size + 1, 2 * size + 2]
        n = np.r_[root_c[frequent], count, root_c[s.own].sum(), s.root_t[s.own].sum(), (root_c[s.own] > 0).sum()]
        out.append((1, sweep, self.part, self.part, b"", _packed(at, np.uint32), _packed(n, np.uint64)))
        out.append((2, sweep, self.part, self.part, b"", _packed(s.t[s.c > 1], np.uint32), _packed(s.root_t, np.uint32)))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _TOLD_KINDS, strict=True)], _TOLD)


_TOLD = ["kind", "sweep", "to", "part", "a", "b", "c"]
_TOLD_KINDS = (*(pa.int32(),) * 4, *(pa.binary(),) * 3)
_TOLD_SCHEMA = "kind int, sweep int, to int, part int, a binary, b binary, c binary"


def _started(book: np.ndarray, partitions: int):
    return lambda messages: _Part(messages, book, partitions).told(0)


def _owned(messages: pa.Table) -> pa.Table:
    """The totals of an owner's contexts, to every partition in the order in which it named them (kind 3)."""
    rows = messages.to_pylist()
    hashes = [np.frombuffer(r["a"], np.uint64) for r in rows]
    uniq, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unpacked(r[x], np.uint32) for r in rows]), len(uniq))[at] for x in "bc"]
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    out = [(3, r["sweep"], r["to"], r["part"], b"", _packed(c, np.uint32), _packed(t, np.uint32)) for r, c, t in zip(rows, np.split(sums[0], ends), np.split(sums[1], ends), strict=True)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _TOLD_KINDS, strict=True)], _TOLD)


def _for_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for the root over the partitions in one task."""
    total = np.zeros(2 * ESCAPE + 3, np.int64)
    for batch in batches:
        for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[_unpacked(at, np.uint32)] += _unpacked(n, np.uint64).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def _rng(part: int, sweep: int) -> np.random.Generator:
    return np.random.default_rng([SEED, part + 1, sweep])


def _swept(book: np.ndarray, partitions: int, root: Root, sweep: int):
    def run(messages: pa.Table, told: pa.Table) -> pa.Table:
        part, rows = _Part(messages, book, partitions), told.to_pylist()
        part.restore(next(r for r in rows if r["kind"] == 2))
        part.seating.sweep(part.totals([r for r in rows if r["kind"] == 3])[1], root, _rng(part.part, sweep))
        return part.told(sweep)

    return run


def _scored(book: np.ndarray, partitions: int, roots: dict[int, Root], counts: np.ndarray):
    """For each block, the log10 probability and the training tokens of the word of each of its pairs."""

    def run(messages: pa.Table, told: pa.Table) -> pa.Table:
        part, rows = _Part(messages, book, partitions), told.to_pylist()
        s, p = part.seating, np.zeros(len(part.word))
        for k, root in roots.items():
            part.restore(next(r for r in rows if r["kind"] == 2 and r["sweep"] == k))
            customers, tables = part.totals([r for r in rows if r["kind"] == 3 and r["sweep"] == k])
            t = np.zeros(len(part.word), np.int64)
            t[part.eaten] = s.t
            p += s.probabilities(part.word, part.context, part.count, t, customers, tables, root)
        model = np.log10(p / len(roots))[part.pairs].astype(np.float32)
        n = np.bincount(s.word, s.c, len(s.place))
        n[~s.own] = counts[s.place[~s.own]]
        n, at, out = n[part.word][part.pairs], 0, []
        for first, size in part.blocks:
            out.append((first, part.part, model[at : at + size].tobytes(), _packed(n[at : at + size], np.uint64)))
            at += size
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["first", "part", "model", "n"])

    return run


def _gathered(home: pa.Table, told: pa.Table) -> pa.Table:
    """doc_id, tokens, known tokens, and the sums of both logarithms of the rows of one block."""
    h = home.select(["words", "pairs", "contexts"]).to_pylist()[0]
    rows, tokens, n = _unpacked(h["words"], np.uint16), _unpacked(h["pairs"], np.uint32), _unpacked(h["contexts"], np.uint32)
    told = told.select(["part", "model", "n"]).sort_by("part").to_pylist()
    model = np.concatenate([np.frombuffer(r["model"], np.float32) for r in told]).astype(float)
    count = np.concatenate([_unpacked(r["n"], np.uint64) for r in told]).astype(float)
    sums = [np.bincount(rows, np.repeat(x, tokens), len(n)) for x in (count > 0, np.log10(count + 0.1), model)]
    ids = pa.concat_arrays([c.flatten() for c in home.column("doc_ids").chunks])
    return pa.Table.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "n_tokens", "known", "base", "model"])


def score_texts(docs: DataFrame, learns: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows where ``learns``."""
    spark = docs.sparkSession
    ready_for_checkpoints(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(learns, F.lit(True)).alias("learns"))

    often = stored(rows.mapInArrow(_frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "frequent")
    n_train = often.filter("hash = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = often.filter((F.col("hash") != 0) & (F.col("n") * HEAVY * 2 >= n_train)).collect()  # 2 * HEAVY at most
    book = np.sort(np.array([r["hash"] for r in frequent], np.int64).view(np.uint64))
    dropped(often)
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Texts that only are scored are held as well; words of the usual length don't change the number.
    partitions = max(LEAST_PARTITIONS, -(-n_train // TOKENS_EACH), -(-n_bytes // (BYTES_A_TOKEN * TOKENS_EACH)))

    names = f"kind int, part int, first long, words binary, words_rest binary, pairs binary, contexts binary, contexts_rest binary, trained binary, doc_ids array<{kind}>"
    routed = checkpointed(rows.mapInArrow(_routed(book, partitions), names), partitions, "part")
    pairs = routed.filter("kind = 0").drop("doc_ids").groupBy("part")

    def exchanged(told: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """What goes back to the partitions, their own seating and the totals of their contexts, and the sums for the root."""
        with settings(spark, CLEAN):
            out = stored(told, "told")
            owned = out.filter("kind = 0").groupBy("to").applyInArrow(_owned, _TOLD_SCHEMA)
            back = stored(out.filter("kind = 2").unionByName(owned), "back")
            summed = out.filter("kind = 1").select("b", "c").repartition(-(-partitions // 64)).mapInArrow(_for_root, "at long, n long")
            total = np.zeros(2 * ESCAPE + 3, np.int64)
            for r in summed.groupBy("at").agg(F.sum("n").alias("n")).collect():
                total[r["at"]] = r["n"]
            dropped(out)
        return back, total

    def next_root(total: np.ndarray, t: np.ndarray) -> Root:
        return Root(total[: len(book)].sum() + total[-3], t.sum() + total[-2], int(len(book) + total[-1]), total[: len(book)], t)

    back, total = exchanged(pairs.applyInArrow(_started(book, partitions), _TOLD_SCHEMA))
    counts, root = total[ESCAPE : ESCAPE + len(book)], next_root(total, np.ones(len(book), np.int64))
    roots, kept = {}, None
    for sweep in range(1, SWEEPS + 1):
        old, tables, base = back, root.tables, root.base
        back, total = exchanged(pairs.cogroup(old.groupBy("part")).applyInArrow(_swept(book, partitions, root, sweep), _TOLD_SCHEMA))
        if sweep - 1 not in roots:
            dropped(old)
        c = total[: len(book)]
        t = _tables(c, np.minimum(root.t, c), 1, np.full(len(c), tables), np.full(len(c), base), _rng(-1, sweep))
        root = next_root(total, t)
        if sweep > BURN_IN:
            roots[sweep] = root
            kept = back if kept is None else kept.unionByName(back)

    scored = pairs.cogroup(kept.groupBy("part")).applyInArrow(_scored(book, partitions, roots, counts), "first long, part int, model binary, n binary")
    home = routed.filter("kind = 1").select("first", "words", "pairs", "contexts", "doc_ids").groupBy("first")
    out = home.cogroup(scored.groupBy("first")).applyInArrow(_gathered, f"doc_id {kind}, n_tokens long, known long, base double, model double")
    whole = float(np.log10(n_train + 0.1 * (root.distinct + 1)))
    return out.select("doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(int(n_train)).alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), F.col("model").alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))
