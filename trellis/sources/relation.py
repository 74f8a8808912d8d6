"""The input: one flat relation whose attributes go by position."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: An attribute of at most so many values has its codes broadcast.
MAX_BROADCAST_VALUES = 100_000


@dataclass
class Relation:
    """Attribute i is column a{i}; ``names`` are the columns' own names. NULL is a value like any other.

    ``weighted`` has each distinct row once with the number of its copies (w): every count that entropies need is a sum
    of w, and decompositions, which see a relation as a set, need no more than its rows."""

    df: DataFrame
    names: list[str]
    label: str = "relation"
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str] | None = None, label: str = "relation", dedupe: bool = False) -> Relation:
        names = list(columns or df.columns)
        if len(names) > 63:
            raise ValueError("a mask holds 63 attributes at most")
        rows = df.select(*(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(names)))
        return cls(rows.distinct() if dedupe else rows, names, label)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def n(self) -> int:
        return len(self.names)

    @property
    def full(self) -> int:
        return (1 << self.n) - 1

    def columns(self, mask: int) -> list[str]:
        return [f"a{i}" for i in range(self.n) if mask >> i & 1]

    @cached_property
    def weighted(self) -> DataFrame:
        out = self.df.groupBy(*self.df.columns).agg(F.count(F.lit(1)).alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(out)
        return out

    def size_rows(self) -> DataFrame:
        """One row of sizes."""
        return self.weighted.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint"), F.count(F.lit(1)))

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """(rows, distinct rows)"""
        return tuple(self.size_rows().first())

    @property
    def rows(self) -> int:
        return self.sizes[0]

    @property
    def distinct_rows(self) -> int:
        return self.sizes[1]

    def project(self, mask: int) -> DataFrame:
        """Distinct tuples of some attributes."""
        return self.weighted.select(*self.columns(mask)).distinct()

    def codes(self) -> DataFrame:
        """Each attribute's values numbered from 1 in their order, nulls first: (attribute, value, code). A code is a
        value's rank among the distinct values of its attribute, found by range sort and the sizes of the ranges before."""
        parts = []
        for i in range(self.n):
            v = self.df.select(F.col(f"a{i}").alias("v")).distinct().orderBy(F.col("v").asc_nulls_first())
            ranges = v.withColumn("p", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(ranges)
            before, base = {}, 0
            for r in ranges.groupBy("p").count().orderBy("p").collect():  # one row a partition
                before[r["p"]], base = base, base + r["count"]
            starts = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map()
            from pyspark.sql.window import Window

            at = F.row_number().over(Window.partitionBy("p").orderBy(F.col("v").asc_nulls_first()))
            code = (at + starts[F.col("p")]).cast("bigint") if before else at.cast("bigint")
            parts.append(ranges.select(F.lit(i).alias("attribute"), F.col("v").cast("string").alias("value"), code.alias("code")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def encoded(self) -> DataFrame:
        """The relation with codes for values, in the order of codes(). An attribute of few values, which are often hot, takes its
        codes from a broadcast; one of many is joined by shuffle, where Spark splits what is skewed."""
        out = self.df
        for i in range(self.n):
            one = self.codes_of(i).select(F.col("v").alias(f"v{i}"), F.col("code").alias(f"c{i}"))
            if one.count() <= MAX_BROADCAST_VALUES:
                one = F.broadcast(one)
            out = out.join(one, F.col(f"a{i}").eqNullSafe(F.col(f"v{i}"))).drop(f"a{i}", f"v{i}").withColumnRenamed(f"c{i}", f"a{i}")
        return out.select(*(f"a{i}" for i in range(self.n)))

    def codes_of(self, i: int) -> DataFrame:
        one = Relation(self.df.select(F.col(f"a{i}").alias("a0")), [self.names[i]])
        kind = self.df.schema[f"a{i}"].dataType
        codes = one.codes().select(F.col("value").cast(kind).alias("v"), "code")
        self._kept += one._kept
        return codes

    def release(self) -> None:
        """Give back what was kept in memory."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()


def read_csv(spark: SparkSession, path: str, header: bool = False, quoted: bool = True, columns: int | None = None, label: str | None = None) -> Relation:
    """A comma-separated file of opaque strings. Blanks around a cell go, blank lines too; cells missing at the end of a
    line are NULL. ``columns`` keeps the first so many; without it their number is that of the first line."""
    reader = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    reader = reader.option("quote", '"' if quoted else "").option("emptyValue", "").option("mode", "PERMISSIVE")
    df = reader.csv(path)
    names = df.columns[:columns] if columns else df.columns
    return Relation.of(df.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in names)), label=label or path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> Relation:
    """A relation from a database; ``options`` are those of Spark's JDBC source, partitioning included."""
    return Relation.of(spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load())


def from_rows(spark: SparkSession, rows: Iterable[Sequence], names: Sequence[str]) -> Relation:
    """A small relation given in the program; its cells become strings."""
    data = [tuple(None if v is None else str(v) for v in r) for r in rows]
    return Relation.of(spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in names)))


def arity(spark: SparkSession, path: str) -> int:
    """The number of cells in a file's first line."""
    return len(spark.read.csv(path).columns)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """The files of a folder in any store Spark reads, smallest first, ties by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/" + pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [p for _, p in sorted((s.getLen(), s.getPath().toString()) for s in found if s.isFile())]
