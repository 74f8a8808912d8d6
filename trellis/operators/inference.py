"""What known dependencies say about others: bounds by lattice order and by the dependency basis."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Protocol

from ..functions import bits

Known = tuple[int, int, float]  # left side, right side, measure


class Inference(Protocol):
    def infer(self, lhs: int, rhs: int) -> float: ...

    def implies(self, lhs: int, rhs: int, alpha: float) -> bool: ...


class LatticeOrder:
    """A known X' -> Y (or ->>) bounds every X -> Y with X' part of X."""

    def __init__(self, known: Iterable[Known]):
        self.known = list(known)

    def infer(self, lhs: int, rhs: int) -> float:
        return min((m for x, y, m in self.known if y == rhs and x & lhs == x), default=math.inf)

    def implies(self, lhs: int, rhs: int, alpha: float) -> bool:
        return self.infer(lhs, rhs) <= alpha


def dependency_basis(lhs: int, known: Iterable[Known], n: int) -> dict[int, float]:
    """The blocks of the attributes outside lhs, each with a bound of lhs ->> block, by refinement: a block b is split by
    a known S ->> T with S and b disjoint and both b - T and b & T non-empty; the measures add up."""
    known = list(known)
    blocks = {bits.full(n) & ~lhs: 0.0}
    changed = True
    while changed:
        changed = False
        for s, t, m in known:
            for b, bound in list(blocks.items()):
                if not s & b and b & t and b & ~t:
                    del blocks[b]
                    blocks[b & t] = blocks[b & ~t] = bound + m
                    changed = True
    blocks.pop(0, None)
    return blocks


class Basis:
    """Bounds of lhs ->> rhs where rhs is a union of blocks of the dependency basis."""

    def __init__(self, known: Iterable[Known], n: int):
        self.known, self.n = list(known), n

    def infer(self, lhs: int, rhs: int) -> float:
        inside = {b: m for b, m in dependency_basis(lhs, self.known, self.n).items() if b & rhs}
        if any(b & ~rhs for b in inside):
            return math.inf
        return sum(inside.values())

    def implies(self, lhs: int, rhs: int, alpha: float) -> bool:
        return self.infer(lhs, rhs & ~lhs) <= alpha

    def infer_batch(self, deps: Iterable[tuple[int, int]]) -> list[float]:
        return [self.infer(x, y) for x, y in deps]
