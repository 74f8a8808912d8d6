"""The entry points: mine separators and full MVDs, search lattices, enumerate and judge acyclic schemas."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import measures, search, separators
from ..operators import schema as schemas
from ..operators.decompose import Decomposition, DecompositionJobs
from ..operators.entropy import CUBE_ATTRIBUTES, EntropyOracle, OutOfTime
from ..operators.measures import JD
from ..sources import sepfile
from ..sources.relation import Relation, list_files, read_csv


def deadline(timeout: float | None):
    """A test of whether so many seconds have passed."""
    end = None if timeout is None else time.monotonic() + timeout
    return lambda: end is not None and time.monotonic() > end


def ending(timeout: float | None) -> float | None:
    """When so many seconds will have passed."""
    return None if timeout is None else time.monotonic() + timeout


def oracle_of(relation: Relation, range_size: int | None = None, end: float | None = None) -> EntropyOracle:
    """An oracle, with the sets within runs of range_size neighbouring attributes known already; a small relation's
    cube comes whole, as one job beats many. At ``end`` loading stops, and what is known then is all."""
    oracle = EntropyOracle(relation, end=end)
    try:
        if range_size is None and relation.n <= 8:
            oracle.load_cube()
        elif range_size:
            oracle.load_ranges(min(range_size, CUBE_ATTRIBUTES))
    except OutOfTime:
        pass
    return oracle


@dataclass
class Mined:
    epsilon: float
    separators: dict[tuple[int, int], dict[int, JD]]
    full_mvds: list[JD]
    complete_separators: bool
    complete_full_mvds: bool
    metrics: dict = field(default_factory=dict)

    @property
    def distinct_separators(self) -> list[int]:
        return separators.distinct_separators(self.separators)


def mine(relation: Relation, epsilon: float, timeout: float | None = None, range_size: int | None = None, with_full_mvds: bool = True, oracle: EntropyOracle | None = None) -> Mined:
    """All minimal separators and, over each, all full MVDs. At the timeout the running job is cancelled and what was found so
    far is returned, with the flags that say whether it is everything."""
    began, late = time.monotonic(), deadline(timeout)
    oracle = oracle or oracle_of(relation, range_size, ending(timeout))
    prepared = time.monotonic()
    found, complete = separators.minimal_separators(oracle, epsilon, late)
    mvds, complete_mvds = separators.full_mvds(oracle, separators.distinct_separators(found), epsilon, late) if with_full_mvds else ([], False)
    total = time.monotonic() - began
    m = oracle.metrics
    metrics = {
        "attributes": relation.n, "rows": relation.rows if complete else relation.__dict__.get("sizes", (None,))[0], "threshold": epsilon, "range_size": range_size, "timeout": timeout,
        "completed_separators": complete, "completed_full_mvds": complete and complete_mvds, "separators": len(separators.distinct_separators(found)), "full_mvds": len(mvds),
        "prepare_seconds": prepared - began, "queries": m.jobs, "query_seconds": m.seconds, "total_seconds": total, "percent_querying": 100 * m.seconds / total if total else 0.0,
        "cached_entropies": len(oracle.known), "tuples": m.tuples,
    }
    return Mined(epsilon, found, mvds, complete, complete and complete_mvds, metrics)


@dataclass
class Searched:
    mvds: list[tuple[int, int, float]]
    complete: bool
    metrics: dict


def search_mvds(relation: Relation, alpha: float, timeout: float | None = None) -> Searched:
    """All MVDs with measure <= alpha, by the bottom-up search."""
    began, oracle, complete = time.monotonic(), EntropyOracle(relation, end=ending(timeout)), True
    try:
        found = search.all_mvds(oracle, alpha, deadline(timeout))
    except search.Stopped as s:
        found, complete = s.found, False
    total = time.monotonic() - began
    m = oracle.metrics
    return Searched(found, complete, {"attributes": relation.n, "rows": relation.rows if complete else relation.__dict__.get("sizes", (None,))[0], "threshold": alpha, "mvds": len(found), "scans": m.jobs, "scan_seconds": m.seconds, "total_seconds": total, "percent_scanning": 100 * m.seconds / total if total else 0.0})


@dataclass
class Judged:
    schema: schemas.AcyclicSchema
    decomposition: Decomposition | None


def enumerate_schemas(relation: Relation, jds: Iterable[JD], timeout: float | None = None, jobs: DecompositionJobs | None = None) -> Iterator[Judged]:
    """The acyclic schemas of the JDs, each with its decomposition, until the time is up; one that is still being judged then
    is cancelled."""
    end, own = ending(timeout), jobs is None
    jobs = jobs or DecompositionJobs(relation)
    try:
        for s in schemas.acyclic_schemas(relation.n, list(jds)):
            left = None if end is None else end - time.monotonic()
            if left is not None and left <= 0:
                return
            try:
                judged = Judged(s, jobs.run(s.clusters, left))
            except TimeoutError:
                return
            yield judged
    finally:
        if own:
            jobs.stop(wait=end is None or time.monotonic() < end)


# ---- sinks -----------------------------------------------------------------------------------------------------------


def write_metrics(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Append rows of metrics to a folder of CSV files with a header."""
    cells = [{k: None if v is None else str(v) for k, v in r.items()} for r in rows]
    schema = ", ".join(f"`{k}` string" for k in cells[0])
    spark.createDataFrame([tuple(r.values()) for r in cells], schema).coalesce(1).write.mode("append").option("header", True).csv(path)


def schema_rows(judged: Iterable[Judged], threshold: float, began: float) -> Iterator[dict]:
    """A row of metrics for each schema."""
    for i, j in enumerate(judged):
        s, d = j.schema, j.decomposition
        yield {"threshold": threshold, "elapsed_seconds": time.monotonic() - began, "schema": i, "jds": len(s.jds), "measure": s.measure, "clusters": len(s.clusters), "largest_cluster": s.largest_cluster, "largest_separator": s.largest_separator, "largest_relation": d.largest, "tuples": d.tuples, "cells": d.cells, "spurious": d.spurious}


def tree_rows(spark: SparkSession, found: Iterable[schemas.AcyclicSchema]) -> DataFrame:
    rows = [(i, k, x.parent, x.kind, x.level, x.members) for i, s in enumerate(found) for k, x in enumerate(s.tree())]
    return spark.createDataFrame(rows, "schema_id int, node_id int, parent_id int, kind string, level int, members bigint")


def separator_rows(spark: SparkSession, mined: Mined) -> DataFrame:
    rows = [(x, y, s) for (x, y), found in sorted(mined.separators.items()) for s in sorted(found)]
    return spark.createDataFrame(rows, "x int, y int, separator bigint")


def jd_rows(spark: SparkSession, jds: Iterable[JD]) -> DataFrame:
    """(lhs, components, measure), six digits."""
    return spark.createDataFrame([(d.lhs, list(d.components), round(d.measure, 6) + 0.0) for d in jds], "lhs bigint, components array<bigint>, measure double")


# ---- batches over folders --------------------------------------------------------------------------------------------


def mine_folder(spark: SparkSession, folder: str, out: str, thresholds: Iterable[float], ranges: Iterable[int | None] = (None,), timeouts: Iterable[float | None] = (None,), with_full_mvds: bool = True, header: bool = False) -> list[dict]:
    """Mine every file of a folder, smallest first, for each threshold, range size and timeout: metrics go to
    <out>/metrics, full MVDs to .sep files that name their run."""
    rows = []
    for path in list_files(spark, folder, "*.csv"):
        relation = read_csv(spark, path, header=header)
        for timeout in timeouts:
            for size in ranges:
                for epsilon in thresholds:
                    got = mine(relation, epsilon, timeout, size, with_full_mvds)
                    rows.append({"file": path, **got.metrics})
                    name = sepfile.sep_name(path.rsplit("/", 1)[-1], timeout or 0, size or 0, epsilon)
                    sepfile.write_sep(spark, f"{out.rstrip('/')}/{name}", relation.n, got.full_mvds)
        relation.release()
    if rows:
        write_metrics(spark, rows, f"{out.rstrip('/')}/metrics")
    return rows


def enumerate_folder(spark: SparkSession, relation: Relation, folder: str, out: str, timeout: float | None = None) -> list[dict]:
    """Enumerate the schemas of every .sep file of a folder, in order of the thresholds in their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.sep")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted((s.getPath().toString() for s in found), key=lambda p: (sepfile.threshold_of(p) or 0.0, p))
    rows = []
    for name in names:
        jds = [JD(r["lhs"], tuple(r["components"]), r["measure"]) for r in sepfile.read_sep(spark, name).collect()]
        began = time.monotonic()
        rows += [{"file": name, **r} for r in schema_rows(enumerate_schemas(relation, jds, timeout), sepfile.threshold_of(name) or 0.0, began)]
    if rows:
        write_metrics(spark, rows, out)
    return rows


def search_folder(spark: SparkSession, folder: str, out: str, alphas: Iterable[float], timeout: float | None = None, header: bool = False) -> list[dict]:
    """search_mvds() over every file of a folder, smallest first."""
    rows = []
    for path in list_files(spark, folder, "*.csv"):
        relation = read_csv(spark, path, header=header)
        for alpha in alphas:
            got = search_mvds(relation, alpha, timeout)
            rows.append({"file": path, "completed": got.complete, **got.metrics})
        relation.release()
    if rows:
        write_metrics(spark, rows, out)
    return rows


def verify(relation: Relation, epsilon: float) -> list[str]:
    """Mined separators against those that all MVDs imply; what differs, in words."""
    oracle = oracle_of(relation)
    mined = mine(relation, epsilon, with_full_mvds=False, oracle=oracle)
    truth = separators_of_mvds(search.all_mvds(oracle, epsilon), relation.n)
    return [f"{p}: mined {sorted(mined.separators.get(p, {}))}, implied {sorted(truth.get(p, set()))}" for p in sorted(set(mined.separators) | set(truth)) if set(mined.separators.get(p, {})) != truth.get(p, set())]


def self_check(relation: Relation, epsilon: float) -> list[str]:
    """Each mined separator by itself: its witness holds and keeps the pair apart, and no set with one attribute less
    separates the pair; what fails, in words."""
    oracle = oracle_of(relation)
    bad = []
    for (x, y), found in mine(relation, epsilon, with_full_mvds=False, oracle=oracle).separators.items():
        for s, w in found.items():
            if not w.splits(x, y) or measures.exceeds(measures.jd(oracle, s, w.components, oracle.full), epsilon):
                bad.append(f"{(x, y)}: {w} is no witness of {s}")
            less, _ = separators.run(oracle, {i: separators.witness(oracle, x, y, s & ~(1 << i), epsilon) for i in bits.members(s)})
            bad += [f"{(x, y)}: {s} does without {i}" for i, w in less.items() if w is not None]
    return bad


def separators_of_mvds(mvds: Iterable[tuple[int, int, float]], n: int) -> dict[tuple[int, int], set[int]]:
    """The minimal separators that a complete set of MVDs implies: the left sides of those that split a pair."""
    sides: dict[tuple[int, int], set[int]] = {}
    for lhs, rhs, _ in mvds:
        rest = ((1 << n) - 1) & ~lhs & ~rhs
        for x in range(n):
            for y in range(x + 1, n):
                if (rhs >> x & 1 and rest >> y & 1) or (rhs >> y & 1 and rest >> x & 1):
                    sides.setdefault((x, y), set()).add(lhs)
    return {p: {s for s in found if not any(t != s and s & t == t for t in found)} for p, found in sides.items()}


def describe(d: Decomposition) -> dict:
    return asdict(d)
