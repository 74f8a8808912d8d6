"""Entropies of attribute sets, many in one scan."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..sources.relation import Relation

#: Grouping sets of one job: each multiplies the rows that enter the aggregation.
SETS_PER_JOB = 64
#: Rows that one job expands to at most: larger relations get fewer sets to a job.
ROWS_PER_JOB = 20_000_000_000
#: A full cube is for relations of at most so many attributes.
CUBE_ATTRIBUTES = 12


def grouped_counts(relation: Relation, masks: Iterable[int]) -> DataFrame:
    """(mask, a..., c): how often each tuple of each attribute set occurs; attributes outside a set are NULL there, and
    mask tells them from NULL values.

    Rows are first counted by all attributes that any set needs, on the rows' own side of the shuffle; the sets are then
    grouping sets over these counts: one scan, one exchange."""
    masks = sorted(set(masks))
    used = 0
    for m in masks:
        used |= m
    columns = relation.columns(used)
    if not columns:
        return relation.weighted.agg(F.sum("w").alias("c")).where("c is not null").select(F.lit(0).cast("bigint").alias("mask"), "c")
    base = relation.weighted if used == relation.full else relation.weighted.groupBy(*columns).agg(F.sum("w").alias("w"))
    out = _grouped(base, columns, [relation.columns(m) for m in masks], "mask")
    # the empty set groups nothing also when there are no rows
    return out.where("w is not null").select("mask", *columns, F.col("w").alias("c"))


def _grouped(rows: DataFrame, columns: list[str], sets: list[list[str]], name: str, always: tuple[str, ...] = ()) -> DataFrame:
    """Sums of w by each of the sets of columns (and ``always``): those columns, w, and in ``name`` the mask of the set."""
    counted = rows.groupingSets([[F.col(c) for c in (*always, *s)] for s in sets], *map(F.col, (*always, *columns)))
    # grouping_id has a bit for each column, the first the highest, set if it is not grouped by
    out = counted.agg(F.grouping_id().alias("_g"), F.sum("w").alias("w"))
    k, zero = len(columns), F.lit(0).cast("bigint")
    mask = zero
    for j, c in enumerate(columns):
        mask = mask.bitwiseOR(F.when(F.col("_g").bitwiseAND(F.lit(1 << (k - 1 - j))) == 0, F.lit(1 << int(c[1:])).cast("bigint")).otherwise(zero))
    return out.select(*always, *columns, "w", mask.alias(name))


def cube_counts(relation: Relation) -> DataFrame:
    """grouped_counts() of all attribute sets, in two steps: all subsets of one half of the attributes, each with the whole
    other half; then, from these sums, all subsets of the other half. A row is expanded to 2**(n/2) instead of 2**n, and what
    the first step has summed up is not expanded again."""
    columns = relation.columns(relation.full)
    half = len(columns) // 2
    first, second = columns[:half], columns[half:]
    subsets = lambda cs: [[c for i, c in enumerate(cs) if m >> i & 1] for m in range(1 << len(cs))]
    # sets of the first half, each with the whole second half; then the same the other way round
    one = _grouped(relation.weighted, first, subsets(first), "_m1", tuple(second))
    two = _grouped(one, second, subsets(second), "_m2", ("_m1", *first))
    return two.select((F.col("_m1") + F.col("_m2")).alias("mask"), *columns, F.col("w").alias("c"))


def entropies(relation: Relation, masks: Iterable[int]) -> DataFrame:
    """(mask, h, groups, most, rows): entropy in bits, number of distinct tuples, copies of the most frequent one, rows.

    h = log2(rows) - sum(c log2 c) / rows: a tuple that occurs once adds nothing to the sum. No rows: no result."""
    return _of_counts(grouped_counts(relation, masks))


def _of_counts(counts: DataFrame) -> DataFrame:
    c = F.col("c").cast("double")
    sums = counts.groupBy("mask").agg(F.sum(c * F.log2(c)).alias("s"), F.sum("c").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("c").alias("most"))
    h = F.greatest(F.lit(0.0), F.log2(F.col("rows").cast("double")) - F.col("s") / F.col("rows"))
    return sums.select("mask", h.alias("h"), "groups", "most", "rows")


def cube(relation: Relation) -> DataFrame:
    """entropies() of all attribute sets."""
    if relation.n > CUBE_ATTRIBUTES:
        raise ValueError(f"2**{relation.n} sets are too many for one cube; ask for those you need")
    return _of_counts(cube_counts(relation)) if relation.n > 1 else entropies(relation, range(relation.full + 1))


def repeated_values(relation: Relation) -> DataFrame:
    """(attribute, value, c) of the single values that occur more than once."""
    counts = grouped_counts(relation, [1 << i for i in range(relation.n)]).where("c > 1")
    value = F.coalesce(*(F.when(F.col("mask") == 1 << i, F.col(f"a{i}").cast("string")) for i in range(relation.n)))
    attribute = F.log2(F.col("mask").cast("double")).cast("int")
    return counts.select(attribute.alias("attribute"), value.alias("value"), "c")


@dataclass
class Metrics:
    jobs: int = 0
    asked: int = 0
    computed: int = 0
    tuples: int = 0
    seconds: float = 0.0


class OutOfTime(Exception):
    """The time is up; the job that ran was cancelled."""


def interrupt(spark: SparkSession, tag: str, done: threading.Event) -> None:
    """Cancel what runs under a tag, again and again until it is done: a plan that isn't a job yet can't be cancelled."""
    while not done.is_set():
        spark.interruptTag(tag)
        done.wait(0.25)


def collect_until(df: DataFrame, end: float | None) -> list:
    """df.collect(), cancelled if it still runs at ``end`` (of time.monotonic()); then OutOfTime is raised."""
    if end is None:
        return df.collect()
    if time.monotonic() >= end:
        raise OutOfTime
    spark, tag, done, out = df.sparkSession, f"trellis-until-{uuid.uuid4().hex}", threading.Event(), {}

    def work():
        spark.addTag(tag)
        try:
            out["rows"] = df.collect()
        except Exception as e:  # noqa: BLE001 - goes to the caller
            out["error"] = e
        finally:
            done.set()

    threading.Thread(target=work, daemon=True).start()
    if not done.wait(end - time.monotonic()):
        threading.Thread(target=interrupt, args=(spark, tag, done), daemon=True).start()
        raise OutOfTime
    if "error" in out:
        raise out["error"]
    return out["rows"]


@dataclass
class EntropyOracle:
    """Entropies by mask for searches on the driver: what is known is looked up, the rest is computed in batches. At ``end`` (of
    time.monotonic()) a running batch is cancelled and OutOfTime raised; what is known stays.

    A set without repeated tuples makes all its supersets' entropies log2(rows) without another look at the data."""

    relation: Relation
    sets_per_job: int = SETS_PER_JOB
    known: dict[int, float] = field(default_factory=dict)
    keys: list[int] = field(default_factory=list)
    metrics: Metrics = field(default_factory=Metrics)
    end: float | None = None

    def __post_init__(self):
        self.known[0] = 0.0

    @property
    def full(self) -> int:
        return self.relation.full

    def __call__(self, mask: int) -> float:
        if mask not in self.known:
            self.get_many([mask])
        return self.known[mask]

    def _implied(self, mask: int) -> bool:
        if any(mask & k == k for k in self.keys):
            self.known[mask] = math.log2(self.relation.rows)
            return True
        return False

    def get_many(self, masks: Iterable[int]) -> dict[int, float]:
        masks = set(masks)
        self.metrics.asked += len(masks)
        todo = sorted(m for m in masks if m not in self.known and not self._implied(m))
        # small sets first: a key among them spares its supersets
        todo.sort(key=lambda m: (m.bit_count(), m))
        per_job = self.sets_per_job
        if todo:
            per_job = max(1, min(per_job, ROWS_PER_JOB // max(1, self._distinct_rows())))
        while todo:
            part, todo = todo[:per_job], todo[per_job:]
            began = time.monotonic()
            rows = collect_until(entropies(self.relation, part), self.end)  # a row a set
            self.metrics.seconds += time.monotonic() - began
            self.metrics.jobs += 1
            self.metrics.computed += len(part)
            for r in rows:
                self.known[r["mask"]] = r["h"]
                self.metrics.tuples += r["groups"]
                if r["most"] == 1 and not any(r["mask"] & k == k for k in self.keys):
                    self.keys = [k for k in self.keys if k & r["mask"] != r["mask"]] + [r["mask"]]
            for m in part:
                self.known.setdefault(m, 0.0)  # no rows
            todo = [m for m in todo if not self._implied(m)]
        return {m: self.known[m] for m in masks}

    def _distinct_rows(self) -> int:
        if "sizes" not in self.relation.__dict__:
            self.relation.__dict__["sizes"] = tuple(collect_until(self.relation.size_rows(), self.end)[0])
        return self.relation.distinct_rows

    def load_cube(self) -> EntropyOracle:
        """All sets: in one job if that is hardly more than a batch, else in batches, in which keys spare their supersets."""
        if 1 < self.relation.n and 1 << self.relation.n <= 2 * self.sets_per_job:
            began = time.monotonic()
            rows = collect_until(cube(self.relation), self.end)
            self.metrics.seconds += time.monotonic() - began
            self.metrics.jobs += 1
            self.metrics.computed += len(rows)
            self.metrics.tuples += sum(r["groups"] for r in rows)
            self.known.update((r["mask"], r["h"]) for r in rows)
            for r in sorted(rows, key=lambda r: r["mask"].bit_count()):
                if r["most"] == 1 and not any(r["mask"] & k == k for k in self.keys):
                    self.keys.append(r["mask"])
        self.get_many(range(self.full + 1))
        return self

    def load_ranges(self, size: int) -> EntropyOracle:
        """All sets within each run of ``size`` neighbouring attributes."""
        for lo in range(0, self.relation.n, size):
            self.get_many(bits.subsets(bits.span(lo, min(lo + size, self.relation.n))))
        return self

    def load_most_specific(self) -> EntropyOracle:
        """All attributes but one, but two, and all."""
        n, full = self.relation.n, self.full
        self.get_many({full, *(full & ~(1 << i | 1 << j) for i in range(n) for j in range(i, n))})
        return self

    def table(self) -> DataFrame:
        """(mask, h) of what is known."""
        return self.relation.spark.createDataFrame(sorted(self.known.items()), "mask bigint, h double")
