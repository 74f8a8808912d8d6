"""How good a decomposition is: sizes of its projections and of their natural join."""

from __future__ import annotations

import os
import threading
from collections import OrderedDict
from collections.abc import Iterable, Sequence
from concurrent.futures import CancelledError, Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.relation import Relation
from .combinatorics import connected_components
from .entropy import interrupt

_COUNT = "decimal(38,0)"


@dataclass(frozen=True)
class Decomposition:
    clusters: tuple[int, ...]
    smallest: int
    largest: int
    tuples: int
    cells: int
    joined: int
    spurious: int


def projection_sizes(relation: Relation, clusters: Iterable[int]) -> DataFrame:
    """(cluster, tuples): distinct tuples of each cluster, all in one aggregation of grouping sets."""
    from .entropy import grouped_counts

    return grouped_counts(relation, clusters).groupBy(F.col("mask").alias("cluster")).agg(F.count(F.lit(1)).alias("tuples"))


def _same(columns: Sequence[str]):
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))


def _join(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a with b's other columns, joined on columns where NULL equals NULL."""
    other = b.select(*(F.col(c).alias(f"_{c}" if c in columns else c) for c in b.columns))
    return a.join(other, _same(columns)).drop(*(f"_{c}" for c in columns))


def natural_join(relation: Relation, clusters: Sequence[int]) -> DataFrame:
    """The join of the projections itself; clusters in an order in which each shares attributes with those before it."""
    left = sorted(set(clusters))
    seen = left.pop(0)
    out = relation.project(seen)
    while left:
        c = next((c for c in left if c & seen), None)
        if c is None:
            raise ValueError("the clusters fall apart; join_size() multiplies their sizes instead")
        left.remove(c)
        out, seen = _join(out, relation.project(c), relation.columns(c & seen)), seen | c
    return out.distinct()


def _component_size(relation: Relation, clusters: list[int]) -> DataFrame:
    """One row (size): rows of the join of clusters that hang together, without building it.

    An ear, a cluster whose attributes shared with the others all lie in one of them, is summed up by these attributes
    and multiplied into that one: rows never grow. Only what is left of a cyclic set is joined, with what later joins
    still need as grouping columns."""
    parts = {c: relation.project(c).withColumn("n", F.lit(1).cast(_COUNT)) for c in clusters}
    live = sorted(parts, key=lambda c: (c.bit_count(), c))
    while len(live) > 1:
        for ear in live:
            shared = ear & reduce(lambda a, b: a | b, (c for c in live if c != ear))
            host = next((c for c in live if c != ear and c & shared == shared), None)
            if host is not None:
                keys = relation.columns(shared)
                message = parts.pop(ear).groupBy(*keys).agg(F.sum("n").cast(_COUNT).alias("m"))
                joined = _join(parts[host], message, keys)
                parts[host] = joined.select(*relation.columns(host), (F.col("n") * F.col("m")).cast(_COUNT).alias("n"))
                live.remove(ear)
                break
        else:
            a = live[0]
            b = max(live[1:], key=lambda c: ((c & a).bit_count(), -c))
            keys = relation.columns(a & b)
            other = parts[b].withColumnRenamed("n", "m")
            joined = _join(parts[a], other, keys)
            rest = [c for c in live if c not in (a, b)]
            need = (a | b) & reduce(lambda x, y: x | y, rest, 0)
            new = need if need not in parts else a | b
            parts[new] = joined.groupBy(*relation.columns(new)).agg(F.sum((F.col("n") * F.col("m")).cast(_COUNT)).cast(_COUNT).alias("n"))
            live = sorted([*rest, new], key=lambda c: (c.bit_count(), c))
    return parts[live[0]].agg(F.coalesce(F.sum("n"), F.lit(0)).cast(_COUNT).alias("size"))


def join_size(relation: Relation, clusters: Iterable[int]) -> int:
    """Rows of the natural join of the projections. Clusters that share no attributes, directly or through others, would
    meet in a cross join: their sizes are multiplied instead."""
    cs = sorted(set(clusters))
    cs = [c for c in cs if not any(c != d and c & d == c for d in cs)]  # a part of another cluster changes nothing
    edges = [(i, j) for i in range(len(cs)) for j in range(i + 1, len(cs)) if cs[i] & cs[j]]
    size = 1
    for part in connected_components(len(cs), edges):
        size *= int(_component_size(relation, [c for i, c in enumerate(cs) if part >> i & 1]).first()[0])
    return size


def evaluate(relation: Relation, clusters: Iterable[int]) -> Decomposition:
    cs = tuple(sorted(set(clusters)))
    sizes = {r["cluster"]: r["tuples"] for r in projection_sizes(relation, cs).collect()}  # a row a cluster
    counts = [sizes.get(c, 0) for c in cs]
    joined = join_size(relation, cs)
    return Decomposition(cs, min(counts), max(counts), sum(counts), sum(n * c.bit_count() for n, c in zip(counts, cs, strict=True)), joined, joined - relation.distinct_rows)


@dataclass
class Job:
    clusters: tuple[int, ...]
    tag: str
    status: str = "PENDING"  # RUNNING, FINISHED, FAILED, CANCELED
    future: Future = field(default_factory=Future)
    ended: threading.Event = field(default_factory=threading.Event)


class DecompositionJobs:
    """Evaluations side by side: Spark jobs from a few driver threads, each under a tag of its own.

    Asking again for a cluster set gives the same job, or a new one if it was canceled or failed. The results of the last
    ``keep`` sets stay; unfinished jobs are never dropped."""

    def __init__(self, relation: Relation, workers: int | None = None, keep: int = 100):
        self.relation, self.keep = relation, keep
        self.pool = ThreadPoolExecutor(workers or min(4, max((os.cpu_count() or 2) - 1, 1)))
        self.jobs: OrderedDict[tuple[int, ...], Job] = OrderedDict()
        self.lock = threading.Lock()

    def submit(self, clusters: Iterable[int]) -> Job:
        key = tuple(sorted(set(clusters)))
        with self.lock:
            job = self.jobs.get(key)
            if job is not None and job.status not in ("CANCELED", "FAILED"):
                self.jobs.move_to_end(key)
                return job
            job = self.jobs[key] = Job(key, f"trellis-decomposition-{id(self)}-{len(self.jobs)}-{'-'.join(map(str, key))}")
            done = [k for k, j in self.jobs.items() if j.future.done()]
            for k in done[: max(0, len(self.jobs) - self.keep)]:
                del self.jobs[k]
        self.pool.submit(self._run, job)
        return job

    def _run(self, job: Job) -> None:
        spark = self.relation.spark
        with self.lock:
            if job.status == "CANCELED":
                job.ended.set()
                return
            job.status = "RUNNING"
        spark.addTag(job.tag)
        try:
            result = evaluate(self.relation, job.clusters)
        except Exception as e:  # noqa: BLE001 - goes to whoever waits for the job
            self._end(job, "FAILED", lambda: job.future.set_exception(e))
            return
        finally:
            job.ended.set()
            spark.removeTag(job.tag)
        self._end(job, "FINISHED", lambda: job.future.set_result(result))

    def _end(self, job: Job, status: str, tell) -> bool:
        """Tell whoever waits, unless someone was told before."""
        with self.lock:
            if job.future.done():
                return False
            job.status = status
            tell()
            return True

    def run(self, clusters: Iterable[int], timeout: float | None = None) -> Decomposition:
        """The result; one that takes longer than the timeout is cancelled, and TimeoutError raised."""
        job = self.submit(clusters)
        try:
            return job.future.result(timeout)
        except TimeoutError:
            self.cancel(job)
            raise

    def cancel(self, job: Job) -> None:
        if self._end(job, "CANCELED", lambda: job.future.set_exception(CancelledError())):
            threading.Thread(target=interrupt, args=(self.relation.spark, job.tag, job.ended), daemon=True).start()

    def stop(self, wait: bool = True) -> None:
        """Cancel what is open; with ``wait``, until no thread works any more."""
        for job in list(self.jobs.values()):
            self.cancel(job)
        self.pool.shutdown(wait=wait, cancel_futures=True)
