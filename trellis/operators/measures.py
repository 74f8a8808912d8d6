"""Information measures of dependencies, one by one on the driver and as joins with the entropy table."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

#: A measure counts as at most epsilon up to this much above it (floats).
TOLERANCE = 1e-5
#: A measure closer to zero than this is zero.
SNAP = 1e-7

Entropy = Callable[[int], float]


@dataclass(frozen=True, order=True)
class JD:
    """A join dependency: the components are disjoint and, with the left side, make up all attributes."""

    lhs: int
    components: tuple[int, ...]
    measure: float = -1.0

    def __post_init__(self):
        seen = self.lhs
        for c in self.components:
            if c & seen or not c:
                raise ValueError("components must be non-empty, disjoint and apart from the left side")
            seen |= c

    def merged(self, i: int, j: int) -> JD:
        """With components i and j as one; the measure is no longer known."""
        rest = [c for k, c in enumerate(self.components) if k not in (i, j)]
        return JD(self.lhs, tuple(sorted([*rest, self.components[i] | self.components[j]])))

    def with_component_from_lhs(self, attributes: int) -> JD:
        return JD(self.lhs & ~attributes, tuple(sorted([*self.components, attributes & self.lhs])))

    def with_component_to_lhs(self, i: int) -> JD:
        return JD(self.lhs | self.components[i], tuple(c for k, c in enumerate(self.components) if k != i))

    def splits(self, x: int, y: int) -> bool:
        """x and y are in different components."""
        cx = next((c for c in self.components if c >> x & 1), 0)
        return bool(cx) and not cx >> y & 1 and any(c >> y & 1 for c in self.components)

    def refines(self, other: JD) -> bool:
        """Same left side, and each component lies in one of the other's."""
        return self.lhs == other.lhs and all(any(c & o == c for o in other.components) for c in self.components)

    def mvds(self) -> list[tuple[int, int]]:
        """(lhs, rhs) of all two-way splits of the components; the last component is never on the right side."""
        c = self.components
        return [(self.lhs, sum(c[i] for i in bits.members(s))) for s in range(1, 1 << (len(c) - 1))]


def log2(x: float) -> float:
    return math.log2(x)


def snap(x: float) -> float:
    return 0.0 if abs(x) < SNAP else x


def exceeds(measure: float, epsilon: float) -> bool:
    return measure - epsilon > TOLERANCE


def fd(h: Entropy, lhs: int, rhs: int) -> float:
    return snap(h(lhs | rhs) - h(lhs))


def conditional(h: Entropy, a: int, b: int, s: int) -> float:
    """I(a; b | s)"""
    return h(s | a) + h(s | b) - h(s) - h(s | a | b)


def elemental(h: Entropy, x: int, y: int, full: int) -> float:
    """I(x; y | all others)"""
    return conditional(h, 1 << x, 1 << y, full & ~(1 << x | 1 << y))


def mvd(h: Entropy, lhs: int, rhs: int, full: int) -> float:
    """I(rhs; rest | lhs); of a saturated one, whose two sides are all attributes, that of the FD."""
    if lhs | rhs == full:
        return snap(h(full) - h(lhs))
    return snap(h(lhs | rhs) + h(full & ~rhs | lhs) - h(full) - h(lhs))


def jd_sets(lhs: int, components: tuple[int, ...], full: int) -> list[int]:
    return [lhs, full, *(lhs | c for c in components)]


def jd(h: Entropy, lhs: int, components: tuple[int, ...], full: int) -> float:
    """sum of H(lhs + component) - (m - 1) H(lhs) - H(all); rounding below zero is cut off."""
    j = sum(h(lhs | c) for c in components) - (len(components) - 1) * h(lhs) - h(full)
    if j < -1e-4:
        raise ArithmeticError(f"a negative measure: {j}")
    return max(0.0, j)


@dataclass(frozen=True)
class Bounds:
    """What is known of a measure."""

    lower: float = 0.0
    upper: float = math.inf

    def raise_lower(self, v: float) -> Bounds:
        return Bounds(max(self.lower, v), self.upper)

    def cut_upper(self, v: float) -> Bounds:
        return Bounds(self.lower, min(self.upper, v))

    def at(self, v: float) -> Bounds:
        return Bounds(v, v)

    def below(self, v: float) -> bool | None:
        """Whether the measure is at most v; None if unknown."""
        return True if self.upper <= v else False if self.lower > v else None

    def above(self, v: float) -> bool | None:
        known = self.below(v)
        return None if known is None else not known

    @property
    def exact(self) -> bool:
        return self.upper <= SNAP

    def approximate(self, alpha: float) -> bool:
        return self.upper <= alpha


# ---- as plans --------------------------------------------------------------------------------------------------------


def rounded(c: Column) -> Column:
    """Six digits; never minus zero."""
    return F.round(c, 6) + 0.0


def holds(measure: Column, epsilon: float) -> Column:
    return measure <= epsilon + TOLERANCE


def with_entropies(deps: DataFrame, entropies: DataFrame, **masks: Column) -> DataFrame:
    """deps with a column of H for each of the named masks; entropies: (mask, h). One equi-join a mask; the entropy table
    has a row a requested set, which Spark broadcasts while that is small and shuffles otherwise."""
    out = deps
    for name, mask in masks.items():
        out = out.withColumn("_m", mask.cast("bigint")).join(entropies.select(F.col("mask").alias("_m"), F.col("h").alias(name)), "_m", "left").drop("_m")
    return out


def fd_measures(fds: DataFrame, entropies: DataFrame) -> DataFrame:
    """(lhs, rhs, measure) of FDs (lhs, rhs)."""
    got = with_entropies(fds, entropies, h_l=F.col("lhs"), h_lr=bits.c_union(F.col("lhs"), F.col("rhs")))
    m = F.col("h_lr") - F.col("h_l")
    return got.select("lhs", "rhs", F.when(F.abs(m) < SNAP, 0.0).otherwise(m).alias("measure"))


def mvd_measures(mvds: DataFrame, entropies: DataFrame, full: int) -> DataFrame:
    """(lhs, rhs, measure) of MVDs (lhs, rhs)."""
    lhs, rhs = F.col("lhs"), F.col("rhs")
    both = bits.c_union(lhs, rhs)
    rest = bits.c_union(bits.c_minus(F.lit(full), rhs), lhs)
    got = with_entropies(mvds, entropies, h_l=lhs, h_lr=both, h_rest=rest, h_f=F.lit(full))
    m = F.when(both == full, F.col("h_f") - F.col("h_l")).otherwise(F.col("h_lr") + F.col("h_rest") - F.col("h_f") - F.col("h_l"))
    return got.select("lhs", "rhs", F.when(F.abs(m) < SNAP, 0.0).otherwise(m).alias("measure"))


def elemental_measures(pairs: DataFrame, entropies: DataFrame, full: int) -> DataFrame:
    """(x, y, measure) of attribute pairs (x, y): I(x; y | all others)."""
    s = bits.c_minus(F.lit(full), bits.c_union(bits.bit(F.col("x")), bits.bit(F.col("y"))))
    got = with_entropies(pairs, entropies, h_s=s, h_x=bits.c_union(s, bits.bit(F.col("x"))), h_y=bits.c_union(s, bits.bit(F.col("y"))), h_f=F.lit(full))
    return got.select("x", "y", (F.col("h_x") + F.col("h_y") - F.col("h_s") - F.col("h_f")).alias("measure"))


def conditional_measures(rows: DataFrame, entropies: DataFrame) -> DataFrame:
    """rows (a, b, s) with measure I(a; b | s)."""
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    got = with_entropies(rows, entropies, h_a=bits.c_union(s, a), h_b=bits.c_union(s, b), h_s=s, h_all=bits.c_union(bits.c_union(s, a), b))
    return got.select("a", "b", "s", (F.col("h_a") + F.col("h_b") - F.col("h_s") - F.col("h_all")).alias("measure"))


def jd_measures(jds: DataFrame, entropies: DataFrame, full: int) -> DataFrame:
    """(lhs, components, measure) of JDs (lhs, components array<bigint>)."""
    each = jds.select("lhs", "components", F.explode("components").alias("c"))
    sums = with_entropies(each, entropies, h_c=bits.c_union(F.col("lhs"), F.col("c"))).groupBy("lhs", "components").agg(F.sum("h_c").alias("hc"))
    got = with_entropies(sums, entropies, h_l=F.col("lhs"), h_f=F.lit(full))
    m = F.col("hc") - (F.size("components") - 1) * F.col("h_l") - F.col("h_f")
    return got.select("lhs", "components", F.greatest(F.lit(0.0), m).alias("measure"))
