"""Names of patterns of up to three edges that don't depend on a code: shape and label signature."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

from latticework.functions.dfscode import Code, to_graph


def signature(code: Code) -> tuple[str, str]:
    """(shape, signature) of a pattern with one to three edges."""
    labels, adjacent = to_graph(code)
    two = lambda x: f"{x:02d}"

    def reading(walk: tuple[int, ...], closed: bool = False) -> str:
        parts = [two(labels[walk[0]])]
        for a, b in zip(walk, walk[1:]):
            parts += [two(adjacent[a][b]), two(labels[b])]
        return "-".join(parts + [two(adjacent[walk[-1]][walk[0]])] if closed else parts)

    degree = Counter({v: len(n) for v, n in adjacent.items()})
    centre, most = degree.most_common(1)[0]
    if len(code) == 1:
        return "edge", min(reading((0, 1)), reading((1, 0)))
    if len(labels) == 3 and len(code) == 3:
        return "triangle", min(reading(w, True) for w in permutations(labels))
    if most == len(code):
        arms = sorted(f"{two(el)}-{two(labels[v])}" for v, el in adjacent[centre].items())
        return ("wedge" if len(code) == 2 else "star"), "|".join([two(labels[centre]), *arms])
    ends = [v for v, d in degree.items() if d == 1]
    walk = [ends[0]]
    while len(walk) < 4:
        walk.append(next(v for v in adjacent[walk[-1]] if v not in walk))
    return "path", min(reading(tuple(walk)), reading(tuple(walk[::-1])))
