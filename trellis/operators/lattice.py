"""Candidate dependencies: the lattices of FDs and MVDs as tables of masks, and their steps on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

Dep = tuple[int, int]


def _range(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def general_fds(spark: SparkSession, n: int) -> DataFrame:
    """{} -> A for every attribute A."""
    return _range(spark, n, "i").select(F.lit(0).cast("bigint").alias("lhs"), bits.bit(F.col("i")).alias("rhs"))


def saturated_fds(spark: SparkSession, n: int) -> DataFrame:
    """All but A -> A for every attribute A."""
    rhs = bits.bit(F.col("i"))
    return _range(spark, n, "i").select(bits.c_minus(F.lit(bits.full(n)), rhs).alias("lhs"), rhs.alias("rhs"))


def _free(deps: DataFrame, n: int) -> DataFrame:
    """deps with one row for each attribute b that is on neither side."""
    used = bits.c_union(F.col("lhs"), F.col("rhs"))
    return deps.withColumn("b", F.explode(bits.c_members(bits.c_complement(used, n), n)))


def fd_specializations(fds: DataFrame, n: int) -> DataFrame:
    """X + B -> Y for every B on neither side."""
    return _free(fds, n).select(bits.c_add(F.col("lhs"), F.col("b")).alias("lhs"), "rhs").distinct()


def fd_generalizations(fds: DataFrame, n: int) -> DataFrame:
    """X - B -> Y for every B in X."""
    each = fds.withColumn("b", F.explode(bits.c_members(F.col("lhs"), n)))
    return each.select(bits.c_remove(F.col("lhs"), F.col("b")).alias("lhs"), "rhs").distinct()


def general_mvds(spark: SparkSession, n: int) -> DataFrame:
    """{} ->> S for all S of 1 to n/2 + 1 attributes."""
    s = spark.range(1, 1 << n).select(F.lit(0).cast("bigint").alias("lhs"), F.col("id").alias("rhs"))
    return s.where(F.bit_count("rhs") <= n // 2 + 1)


def specific_mvds(spark: SparkSession, n: int) -> DataFrame:
    """All but i and j ->> i for every pair i < j."""
    pairs = _range(spark, n, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("i < j")
    both = bits.c_union(bits.bit(F.col("i")), bits.bit(F.col("j")))
    return pairs.select(bits.c_minus(F.lit(bits.full(n)), both).alias("lhs"), bits.bit(F.col("i")).alias("rhs"))


def mvd_specializations(mvds: DataFrame, n: int) -> DataFrame:
    """X + B ->> Y - B for every B not in X; right sides don't become empty."""
    each = mvds.withColumn("b", F.explode(bits.c_members(bits.c_complement(F.col("lhs"), n), n)))
    return each.select(bits.c_add(F.col("lhs"), F.col("b")).alias("lhs"), bits.c_remove(F.col("rhs"), F.col("b")).alias("rhs")).where("rhs <> 0").distinct()


def mvd_generalizations(mvds: DataFrame, n: int) -> DataFrame:
    """X - B ->> Y and X - B ->> Y + B for every B in X."""
    each = mvds.withColumn("b", F.explode(bits.c_members(F.col("lhs"), n)))
    less = bits.c_remove(F.col("lhs"), F.col("b"))
    sides = each.select(less.alias("lhs"), F.explode(F.array("rhs", bits.c_add(F.col("rhs"), F.col("b")))).alias("rhs"))
    return sides.distinct()


def levels(spark: SparkSession, first: DataFrame, step: Callable[[DataFrame, int], DataFrame], n: int) -> DataFrame:
    """(level, lhs, rhs) of everything that steps reach from first, each at the level it is first reached."""
    seen = first.withColumn("level", F.lit(0))
    at = first
    for level in range(1, n + 1):
        at = step(at, n).join(seen, ["lhs", "rhs"], "left_anti")
        at = spark.createDataFrame(at.collect(), at.schema)  # a lattice of attributes, not data
        if at.isEmpty():
            break
        seen = seen.unionByName(at.withColumn("level", F.lit(level)))
    return seen.select("level", "lhs", "rhs")


def bipartitions(lhs: int, n: int) -> Iterator[Dep]:
    """(lhs, rhs) of all two-way splits of the free attributes; the last free one is never on the right side."""
    free = bits.full(n) & ~lhs
    for s in range(1, 1 << max(0, free.bit_count() - 1)):
        yield lhs, bits.deposit(s, free)


def mvd_candidates(spark: SparkSession, n: int) -> DataFrame:
    """bipartitions() of every left side: (lhs, rhs)."""
    left = spark.range((1 << n) - 1).select(F.col("id").alias("lhs"))
    free = left.withColumn("free", bits.c_members(bits.c_complement(F.col("lhs"), n), n)).where("size(free) >= 2")
    each = free.withColumn("s", F.explode(F.sequence(F.lit(1).cast("bigint"), bits.bit(F.size("free") - 1) - 1)))
    chosen = F.filter(F.transform("free", lambda i, j: F.when(F.col("s").bitwiseAND(bits.bit(j)) != 0, i)), lambda i: i.isNotNull())
    return each.select("lhs", bits.c_of(chosen).alias("rhs"))


def most_specific_jd(lhs: int, n: int) -> tuple[int, ...]:
    """Every free attribute a component of its own."""
    return tuple(1 << i for i in bits.members(bits.full(n) & ~lhs))


def jd_to_mvds(jds: DataFrame) -> DataFrame:
    """All two-way splits of the components of JDs (lhs, components); the last component is never on the right side."""
    each = jds.where("size(components) >= 2").withColumn("s", F.explode(F.sequence(F.lit(1).cast("bigint"), bits.bit(F.size("components") - 1) - 1)))
    rhs = F.aggregate(F.transform("components", lambda c, j: F.when(F.col("s").bitwiseAND(bits.bit(j)) != 0, c).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(c))
    return each.select("lhs", "components", rhs.alias("rhs"))
