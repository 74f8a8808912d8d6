"""Lattice searches for approximate FDs and MVDs, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from . import lattice, measures
from .entropy import EntropyOracle, OutOfTime


class Stopped(Exception):
    """The time is up; what was found so far is in ``found``."""

    def __init__(self, found):
        super().__init__("stopped")
        self.found = found


def _get(oracle: EntropyOracle, masks: set[int], found: list) -> None:
    try:
        oracle.get_many(masks)
    except OutOfTime as e:
        raise Stopped(found) from e


def implied(deps: DataFrame, known: DataFrame) -> DataFrame:
    """deps (lhs, rhs) with the least measure of the known (lhs, rhs, measure) whose left side they include and whose
    right side they share: an upper bound of their own. Joined by right side."""
    k = known.select(F.col("lhs").alias("k_lhs"), F.col("rhs").alias("k_rhs"), F.col("measure").alias("upper"))
    on = (F.col("rhs") == F.col("k_rhs")) & bits.c_covers(F.col("lhs"), F.col("k_lhs"))
    return deps.join(k, on, "left").groupBy("lhs", "rhs").agg(F.min("upper").alias("upper"))


def minimal_fds(oracle: EntropyOracle, alpha: float, deadline=lambda: False) -> list[tuple[int, int, float]]:
    """(lhs, rhs, measure) of all FDs X -> A with measure <= alpha of which no smaller left side has one. Top down: what
    holds is reported and not specialised; candidates above a reported one are dropped before they are measured."""
    n, found = oracle.relation.n, []
    level = [(0, 1 << i) for i in range(n)]
    while level:
        if deadline():
            raise Stopped(found)
        _get(oracle, {m for lhs, rhs in level for m in (lhs, lhs | rhs)}, found)
        rest = []
        for lhs, rhs in level:
            m = measures.fd(oracle, lhs, rhs)
            if m <= alpha + measures.TOLERANCE:
                found.append((lhs, rhs, m))
            else:
                rest.append((lhs, rhs))
        new = {(lhs | 1 << b, rhs) for lhs, rhs in rest for b in range(n) if not (lhs | rhs) >> b & 1}
        level = sorted(d for d in new if not any(r == d[1] and d[0] & x == x for x, r, _ in found))
    return sorted(found)


def minimal_mvds(oracle: EntropyOracle, alpha: float, deadline=lambda: False) -> list[tuple[int, int, float]]:
    """(lhs, rhs, measure) of all MVDs with measure <= alpha of which none with a smaller left side, whose right side is
    theirs or theirs with the attributes moved left, holds. A split is listed once: its last free attribute is not on the
    right side."""
    n, full, found = oracle.relation.n, oracle.full, []
    for size in range(n - 1):
        if deadline():
            raise Stopped(found)
        level = [d for lhs in range(full) if lhs.bit_count() == size for d in lattice.bipartitions(lhs, n)]
        general = [(lhs, rhs) for lhs, rhs, _ in found]
        level = [d for d in level if not any(_generalizes(g, d, full) for g in general)]
        _get(oracle, {m for lhs, rhs in level for m in (lhs, lhs | rhs, full & ~rhs, full)}, found)
        for lhs, rhs in level:
            m = measures.mvd(oracle, lhs, rhs, full)
            if m <= alpha + measures.TOLERANCE:
                found.append((lhs, rhs, m))
    return sorted(found)


def _generalizes(g: tuple[int, int], d: tuple[int, int], full: int) -> bool:
    """g's left side is part of d's, and g's split, without what moved to the left, is d's in one order or the other."""
    (x, y), (lhs, rhs) = g, d
    if x & lhs != x:
        return False
    left = y & ~lhs
    return left in (rhs, full & ~lhs & ~rhs)


def all_mvds(oracle: EntropyOracle, alpha: float, deadline=lambda: False) -> list[tuple[int, int, float]]:
    """(lhs, rhs, measure) of all MVDs with measure <= alpha and of the saturated FDs that reach it. Bottom up: from the
    left sides of n - 2 attributes down, a split is measured only if moving any one attribute to the left leaves one that
    holds (a measure never grows that way)."""
    n, full = oracle.relation.n, oracle.full
    _get(oracle, {full, *(full & ~(1 << i) for i in range(n))}, [])
    saturated = [(full & ~(1 << i), 1 << i) for i in range(n)]
    found = [(lhs, rhs, m) for lhs, rhs in saturated if (m := measures.mvd(oracle, lhs, rhs, full)) <= alpha + measures.TOLERANCE]
    before: set[tuple[int, int]] | None = None
    for size in range(n - 2, -1, -1):
        if deadline():
            raise Stopped(found)
        level = [d for lhs in range(full) if lhs.bit_count() == size for d in lattice.bipartitions(lhs, n)]
        if before is not None:
            level = [d for d in level if _all_specializations(d, before, full)]
        _get(oracle, {m for lhs, rhs in level for m in (lhs, lhs | rhs, full & ~rhs)}, found)
        held = [(lhs, rhs, m) for lhs, rhs in level if (m := measures.mvd(oracle, lhs, rhs, full)) <= alpha + measures.TOLERANCE]
        if not held:
            break
        found += held
        before = {(lhs, s) for lhs, rhs, _ in held for s in (rhs, full & ~lhs & ~rhs)}
    return sorted(found)


def _all_specializations(d: tuple[int, int], before: set[tuple[int, int]], full: int) -> bool:
    lhs, rhs = d
    free = full & ~lhs
    for i in bits.members(free):
        s, rest = rhs & ~(1 << i), free & ~rhs & ~(1 << i)
        if s and rest and (lhs | 1 << i, s) not in before:
            return False
    return True


def brute_force(entropies: DataFrame, n: int, alpha: float, full_entropy_mask: int) -> DataFrame:
    """(lhs, rhs, measure) of every split and saturated FD with measure <= alpha. The entropies of all sets (2**n rows, for
    as many attributes as a cube may have) are computed once, before they are looked up four times a split."""
    spark = entropies.sparkSession
    entropies = spark.createDataFrame(entropies.select("mask", "h").collect(), "mask bigint, h double")
    candidates = lattice.mvd_candidates(spark, n).unionByName(lattice.saturated_fds(spark, n))
    got = measures.mvd_measures(candidates, entropies, full_entropy_mask)
    return got.where(measures.holds(F.col("measure"), alpha))
