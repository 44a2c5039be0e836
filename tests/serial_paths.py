"""The search for full paths one gene and one read after another, to hold the joins of ``operators.alleles`` against."""

from itertools import permutations, product


def _inside(long: tuple, short: tuple) -> list[int]:
    m = len(short)
    return [i for i in range(len(long) - m + 1) if long[i : i + m] == short] if m else []


def _contains(long: tuple, short: tuple) -> bool:
    return bool(_inside(long, short) or _inside(long, short[::-1]))


def _flip(calls: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(("-" if c[0] == "+" else "+") + c[1:] for c in reversed(calls))


def cluster_contexts(contexts: set[tuple], upstream: bool) -> list[tuple]:
    """The shortest member of each cluster; longest first, a context joins the only head that it ends (or begins).

    A context that several heads share tells nothing and is left out.
    """
    heads: dict[tuple, tuple] = {}
    for c in sorted(contexts, key=lambda c: (-len(c), c)):
        fits = [h for h in heads if (h[len(h) - len(c) :] if upstream else h[: len(c)]) == c]
        if len(fits) == 1:
            if len(c) < len(heads[fits[0]]):
                heads[fits[0]] = c
        elif not fits:
            heads[c] = c
    return list(heads.values())


def blocks_between(walks: dict[str, tuple], a: str, b: str) -> dict[str, tuple]:
    """Of each walk that has a and later b, what stands from the first a to the last b."""
    out = {}
    for read, nodes in walks.items():
        if a in nodes and b in nodes:
            i, j = nodes.index(a), len(nodes) - 1 - nodes[::-1].index(b)
            if i < j and None not in nodes[i : j + 1]:
                out[read] = nodes[i : j + 1]
    return out


def full_paths(walks: dict[str, tuple], calls: dict[str, tuple], k: int, gene: str, ends: set[str], threshold: float) -> dict[tuple[str, ...], int]:
    """Paths of calls through ``gene`` and how many reads support each.

    walks: nodes of each read, None where one was removed; no path goes over such a place.
    """
    full: set[tuple] = set()
    for a, b in permutations(sorted(ends), 2):
        found: dict[tuple, tuple[set, set]] = {}
        again = set()
        for block in {min(x, x[::-1]) for x in blocks_between(walks, a, b).values()}:
            up, down = found.setdefault(block, ({()}, {()}))
            for nodes in walks.values():
                fwd, rev = _inside(nodes, block), _inside(nodes, block[::-1]) if block != block[::-1] else []
                if len(fwd) + len(rev) > 1:
                    again.add(block)
                elif fwd or rev:
                    line = nodes if fwd else nodes[::-1]
                    i = _inside(line, block)[0]
                    end = i + len(block)
                    up.update(line[j:i] for j in range(i) if None not in line[j:i])
                    down.update(line[end : j + 1] for j in range(end, len(line)) if None not in line[end : j + 1])
        for block, (up, down) in found.items():
            if block in again:
                continue
            for u, d in product(cluster_contexts(up, True), cluster_contexts(down, False)):
                path = u + block + d
                if any(_contains(w, path) for w in walks.values()):
                    full.add(path)
    longest: list[tuple] = []
    for p in sorted(full, key=lambda p: (-len(p), p)):
        if not any(_contains(q, p) for q in longest):
            longest.append(p)

    def genes_of(path: tuple) -> tuple[str, ...]:
        for read, nodes in walks.items():
            for way in (nodes, nodes[::-1]):
                if at := _inside(way, path):
                    line = calls[read] if way is nodes else _flip(calls[read])
                    return line[at[0] : at[0] + len(path) + k - 1]
        raise ValueError("no read has the path")

    both = {read: (line, _flip(line)) for read, line in calls.items()}
    support = lambda p: sum(any(_inside(line, p) for line in ways) for ways in both.values())
    as_genes = [genes_of(p) for p in longest]
    out: dict[tuple[str, ...], int] = {}
    for n, line in enumerate(as_genes):
        at = [i for i, c in enumerate(line) if c[1:] == gene]
        if not at:
            continue
        others = [o for m, o in enumerate(as_genes) if m != n]
        best = None
        for i in range(at[0] + 1):
            for j in range(at[-1] + 1, len(line) + 1):
                part = line[i:j]
                if any(_inside(o, part) or _inside(_flip(o), part) for o in others):
                    continue
                s = support(part)
                if s >= max(threshold, 1):
                    best = max(filter(None, (best, (len(at), s, len(part), part))))
        if best:
            out[best[3]] = best[1]
    seen = {n for p in longest for n in p}
    for a in sorted(ends - seen):  # anchors outside all blocks are paths of one node
        for read, nodes in walks.items():
            if a in nodes:
                i = nodes.index(a)
                line = calls[read][i : i + k]
                out[min(line, _flip(line))] = sum(a in w for w in walks.values())
                break
    return out


def split_alleles(paths: dict[tuple[str, ...], int], gene: str, calls: dict[str, tuple], positions: dict[str, list]) -> dict[str, list[tuple[str, int, int]]]:
    """allele -> (read, start, end): one allele per copy of the gene in each path.

    A read counts if it has the path once. Of alleles that share a place in a read only the best
    supported one stays.
    """
    found: list[list[tuple[str, int, int]]] = []
    for path in sorted(paths, key=lambda p: (-len(p), p)):
        copies = [i for i, c in enumerate(path) if c[1:] == gene]
        rows: list[list[tuple[str, int, int]]] = [[] for _ in copies]
        for read, line in calls.items():
            fwd = _inside(line, path)
            rev = [] if fwd else _inside(line, _flip(path))
            if len(fwd) + len(rev) != 1:
                continue
            for n, c in enumerate(copies):
                at = fwd[0] + c if fwd else rev[0] + len(path) - 1 - c
                start, end = positions[read][at]
                rows[n].append((read, start, end))
        found += rows
    kept: list[list[tuple[str, int, int]]] = []
    taken: set[tuple[str, int, int]] = set()
    for rows in sorted(filter(None, found), key=lambda r: -len(r)):
        if taken.isdisjoint(rows):
            kept.append(rows)
            taken.update(rows)
    return {f"{gene}_{n}": rows for n, rows in enumerate(kept, 1)}
