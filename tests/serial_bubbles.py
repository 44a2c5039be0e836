"""Bubble operations one after another, to hold the rounds of ``operators.correct`` against."""


def containment(a: set, b: set) -> float:
    """Of the smaller set, the share that the other has too."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def bubble_operations(groups: list[list[tuple[list[tuple[str, int]], float]]], sketches: dict[str, set], threshold: float) -> list[tuple[list, list, list[str]]]:
    """(strong path, weak path, nodes of the weak one claimed) in order: each node is claimed once.

    groups: paths with coverage that share both ends, the longest groups first.
    """
    out, seen = [], set()
    of = lambda path: set().union(*(sketches.get(n, set()) for n, _ in path))
    for group in groups:
        ranked = sorted(group, key=lambda p: (-p[1], p[0]))
        for i, (strong, _) in enumerate(ranked):
            if seen & {n for n, _ in strong[1:-1]}:
                continue
            for weak, _ in ranked[i + 1 :]:
                inner = [n for n, _ in weak[1:-1]]
                if seen & set(inner) or not inner or containment(of(strong), of(weak)) <= threshold:
                    continue
                if strong[0][0] != weak[0][0]:
                    weak = [(n, -d) for n, d in reversed(weak)]
                out.append((strong, weak, inner))
                seen.update(inner)
    return out
