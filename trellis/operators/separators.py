"""Minimal separators of attribute pairs, and the full MVDs over them.

A set S separates x and y if some two-way split of the other attributes, x and y apart, has I <= epsilon given S. Supersets
of separators (without x, y) are separators too. Searches are generators that yield the sets whose entropies they need
next; run() drives those of all pairs in step and turns what they ask for into one batch a round."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable

from ..functions import bits
from .combinatorics import Transversals
from .entropy import EntropyOracle, OutOfTime
from .measures import JD, conditional, elemental, exceeds, jd

Search = Generator[Iterable[int], None, object]


def run(oracle: EntropyOracle, searches: dict, deadline: Callable[[], bool] = lambda: False) -> tuple[dict, bool]:
    """({key: result}, complete) of searches driven in step; at the deadline, or when the oracle runs out of time, those still
    open are dropped."""
    results, live = {}, dict(searches)
    while live:
        if deadline():
            return results, False
        wanted: set[int] = set()
        for key, search in list(live.items()):
            try:
                while True:
                    need = {m for m in next(search) if m not in oracle.known}
                    if need:
                        wanted |= need
                        break
            except StopIteration as end:
                results[key] = end.value
                del live[key]
        try:
            oracle.get_many(wanted)
        except OutOfTime:
            return results, False
    return results, True


def closure(h: EntropyOracle, lhs: int, epsilon: float, x: int | None = None, y: int | None = None) -> Search:
    """The finest components that any JD with this left side and measure <= epsilon can have: any two with
    I(Ci; Cj | lhs) > epsilon are one. None if that joins x and y, or leaves one component."""
    full = h.full
    parts = [1 << i for i in bits.members(full & ~lhs)]
    i = 0
    while i < len(parts):
        yield {lhs, *(lhs | p for p in parts), *(lhs | parts[i] | p for p in parts)}
        for j in range(len(parts)):
            if j != i and exceeds(conditional(h, parts[i], parts[j], lhs), epsilon):
                both = parts[i] | parts[j]
                parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [both]
                if x is not None and both >> x & 1 and both >> y & 1:
                    return None
                i = -1
                break
        i += 1
    return tuple(sorted(parts)) if len(parts) > 1 else None


def witness(h: EntropyOracle, x: int, y: int, s: int, epsilon: float) -> Search:
    """A JD over s that keeps x and y apart with measure <= epsilon, the closure itself if it holds; None if s separates
    them by no split."""
    yield {s, s | 1 << x, s | 1 << y, s | 1 << x | 1 << y}
    if exceeds(conditional(h, 1 << x, 1 << y, s), epsilon):
        return None
    parts = yield from closure(h, s, epsilon, x, y)
    if parts is None:
        return None
    yield {s, h.full, *(s | p for p in parts)}
    if not exceeds(j := jd(h, s, parts, h.full), epsilon):
        return JD(s, parts, j)
    cx, cy = next(p for p in parts if p >> x & 1), next(p for p in parts if p >> y & 1)
    free = [p for p in parts if p not in (cx, cy)]
    for k in range(1 << len(free)):  # merging never raises a measure, so two-way splits are enough
        a = cx | sum(free[i] for i in bits.members(k))
        b = h.full & ~s & ~a
        yield {s | a, s | b}
        if not exceeds(j := jd(h, s, (a, b), h.full), epsilon):
            return JD(s, tuple(sorted((a, b))), j)
    return None


def reduce_to_minimal(h: EntropyOracle, x: int, y: int, s: int, epsilon: float, found: JD) -> Search:
    """(separator, witness) after dropping from s, in ascending order, every attribute that isn't needed."""
    for i in bits.members(s):
        less = yield from witness(h, x, y, s & ~(1 << i), epsilon)
        if less is not None:
            s, found = s & ~(1 << i), less
    return s, found


def minimal_separators_of(h: EntropyOracle, x: int, y: int, epsilon: float) -> Search:
    """{separator: witness} of a pair, complete. Every minimal transversal T of the separators known so far is tried: if
    all attributes but T, x and y separate the pair, they hold a separator that T misses."""
    rest = h.full & ~(1 << x | 1 << y)
    yield {rest, rest | 1 << x, rest | 1 << y, h.full}
    if exceeds(elemental(h, x, y, h.full), epsilon):
        return {}
    first = yield from witness(h, x, y, rest, epsilon)
    if first is None:
        return {}
    s, w = yield from reduce_to_minimal(h, x, y, rest, epsilon, first)
    found, tried = {s: w}, set()
    cover = Transversals([s])
    while open_ := [t for t in cover if t not in tried]:
        t = open_[0]
        tried.add(t)
        w = yield from witness(h, x, y, rest & ~t, epsilon)
        if w is not None:
            s, w = yield from reduce_to_minimal(h, x, y, rest & ~t, epsilon, w)
            found[s] = w
            cover.add(s)
    return found


def minimal_separators(oracle: EntropyOracle, epsilon: float, deadline: Callable[[], bool] = lambda: False) -> tuple[dict[tuple[int, int], dict[int, JD]], bool]:
    """({(x, y): {separator: witness}}, complete) of all pairs x < y."""
    n = oracle.relation.n
    pairs = [(x, y) for x in range(n) for y in range(x + 1, n)]
    return run(oracle, {p: minimal_separators_of(oracle, *p, epsilon) for p in pairs}, deadline)


def full_mvds_of(h: EntropyOracle, lhs: int, epsilon: float, limit: int | None = None) -> Search:
    """All JDs over lhs with measure <= epsilon that no strictly finer one equals or beats: coarser and coarser mergers of
    the closure's components, never of one that holds."""
    start = yield from closure(h, lhs, epsilon)
    if start is None:
        return []
    held: list[JD] = []
    level = {start}
    while level and (limit is None or len(held) < limit):
        yield {m for parts in level for m in (lhs, h.full, *(lhs | p for p in parts))}
        coarser = set()
        for parts in sorted(level):
            if any(d.refines(JD(lhs, parts)) for d in held):
                continue
            j = jd(h, lhs, parts, h.full)
            if not exceeds(j, epsilon):
                held.append(JD(lhs, parts, j))
            elif len(parts) > 2:
                coarser |= {JD(lhs, parts).merged(i, k).components for i in range(len(parts)) for k in range(i + 1, len(parts))}
        level = coarser
    return held[:limit]


def full_mvds(oracle: EntropyOracle, separators: Iterable[int], epsilon: float, deadline: Callable[[], bool] = lambda: False) -> tuple[list[JD], bool]:
    """(full MVDs over the given separators, complete)"""
    got, complete = run(oracle, {s: full_mvds_of(oracle, s, epsilon) for s in sorted(set(separators))}, deadline)
    return sorted(d for ds in got.values() for d in ds), complete


def distinct_separators(found: dict[tuple[int, int], dict[int, JD]]) -> list[int]:
    return sorted({s for of_pair in found.values() for s in of_pair})
