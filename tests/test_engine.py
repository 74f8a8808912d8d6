"""Definitions, ground truths and properties of the mining engine."""

import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.functions import bits
from trellis.operators import combinatorics, decompose, entropy, inference, lattice, measures, schema, search, separators
from trellis.operators.measures import JD
from trellis.plans import fixtures, mining
from trellis.sources import relation as sources
from trellis.sources import sepfile


class Exact:
    """An entropy oracle over rows in memory."""

    def __init__(self, rows, n):
        self.rows, self.n, self.full, self.known = rows, n, 2**n - 1, {}
        self.relation = self

    def __call__(self, m):
        if m not in self.known:
            c = Counter(tuple(r[i] for i in bits.members(m)) for r in self.rows).values()
            t = sum(c)
            self.known[m] = max(0.0, math.log2(t) - sum(x * math.log2(x) for x in c) / t) if t else 0.0
        return self.known[m]

    def get_many(self, masks):
        return {m: self(m) for m in masks}


def brute_mvds(h, eps):
    for s in range(h.full):
        free = bits.members(h.full & ~s)
        for k in range(1, 2 ** (len(free) - 1)):
            y = sum(1 << free[i] for i in bits.members(k))
            if measures.conditional(h, y, h.full & ~s & ~y, s) <= eps + measures.TOLERANCE:
                yield s, y


def partitions(items):
    if not items:
        yield []
        return
    first, rest = 1 << items[0], items[1:]
    for p in partitions(rest):
        yield [first, *p]
        for k in range(len(p)):
            yield [*p[:k], p[k] | first, *p[k + 1 :]]


def brute_separators(h, eps):
    seps = {}
    for s, y in brute_mvds(h, eps):
        for a in bits.members(y):
            for b in bits.members(h.full & ~s & ~y):
                seps.setdefault((min(a, b), max(a, b)), set()).add(s)
    return {p: {s for s in v if not any(t != s and t & s == t for t in v)} for p, v in seps.items()}


def brute_full(h, lhs, eps):
    ok = [JD(lhs, tuple(sorted(p))) for p in partitions(bits.members(h.full & ~lhs)) if len(p) > 1 and measures.jd(h, lhs, tuple(p), h.full) <= eps + measures.TOLERANCE]
    return {d.components for d in ok if not any(e != d and e.refines(d) for e in ok)}


relations = st.integers(2, 5).flatmap(lambda n: st.lists(st.tuples(*[st.integers(0, 2)] * n), min_size=1, max_size=40).map(lambda rows: (rows, n)))


@settings(max_examples=120, deadline=None)
@given(relations, st.sampled_from([0.0, 0.05, 0.3, 0.8]))
def test_separators_and_full_mvds_are_complete(case, eps):
    h = Exact(*case)
    got, complete = separators.minimal_separators(h, eps)
    assert complete
    assert {p: set(v) for p, v in got.items() if v} == brute_separators(h, eps)
    for s in separators.distinct_separators(got):
        found, _ = separators.full_mvds(h, [s], eps)
        assert {d.components for d in found} == brute_full(h, s, eps)
    for (x, y), of in got.items():
        for s, w in of.items():
            assert w.lhs == s and w.splits(x, y)


@settings(max_examples=80, deadline=None)
@given(relations, st.sampled_from([0.0, 0.1, 0.5]))
def test_searches_agree_with_brute_force(case, eps):
    h = Exact(*case)
    found = search.all_mvds(h, eps)
    split = {(s, y) for s, y, _ in found if s | y != h.full}
    assert split == set(brute_mvds(h, eps))
    assert mining.separators_of_mvds(found, h.n) == brute_separators(h, eps)
    for lhs, rhs, m in search.minimal_fds(h, eps):
        assert abs(m - max(0, h(lhs | rhs) - h(lhs))) < 1e-6
        assert all(h((lhs & ~(1 << i)) | rhs) - h(lhs & ~(1 << i)) > eps for i in bits.members(lhs))


@settings(max_examples=100, deadline=None)
@given(relations)
def test_entropy_is_monotone_and_submodular(case):
    h = Exact(*case)
    for a, b in itertools.product(range(h.full + 1), repeat=2):
        assert h(a | b) >= h(a) - 1e-9
        assert h(a) + h(b) >= h(a | b) + h(a & b) - 1e-9


@settings(max_examples=100, deadline=None)
@given(relations)
def test_merging_never_raises_a_measure(case):
    h = Exact(*case)
    if h.n >= 3:
        d = JD(0, tuple(1 << i for i in range(h.n)))
        assert measures.jd(h, 0, d.merged(0, 1).components, h.full) <= measures.jd(h, 0, d.components, h.full) + 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 127), min_size=1, max_size=7))
def test_minimal_transversals(edges):
    hit = [t for t in range(128) if all(t & e for e in edges)]
    assert list(combinatorics.Transversals(edges)) == sorted(t for t in hit if not any(u != t and u & t == u for u in hit))


def test_the_empty_edge_leaves_no_transversal():
    assert list(combinatorics.Transversals([3, 0])) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.data())
def test_maximal_independent_sets(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] != e[1]), max_size=10))
    free = [s for s in range(1 << n) if not any(s >> a & 1 and s >> b & 1 for a, b in edges)]
    got = list(combinatorics.Graph(n, edges).maximal_independent_sets())
    assert len(got) == len(set(got))
    assert set(got) == {s for s in free if not any(t != s and s & t == s for t in free)}


def test_deadlines_give_part_of_the_result():
    h = Exact([(0, 0, 1), (0, 1, 0), (1, 1, 1)], 3)
    got, complete = separators.minimal_separators(h, 0.1, lambda: True)
    assert got == {} and not complete
    with pytest.raises(search.Stopped):
        search.all_mvds(h, 0.1, lambda: True)


# ---- ground truths ---------------------------------------------------------------------------------------------------

HEADS = {
    "nation_region": (25, 25, 4.643856), "supp_geo": (100, 100, 6.643856), "cust_geo": (1500, 125, 6.907744),
    "orders_dim": (15000, 1187, 10.156202), "part_dim": (2000, 2000, 10.965784), "line_flags": (60000, 51367, 15.572639),
}
SEPARATORS = {("nation_region", 0.0): 10, ("nation_region", 0.1): 10, ("supp_geo", 0.0): 24, ("supp_geo", 0.1): 24, ("cust_geo", 0.0): 18, ("cust_geo", 0.1): 14, ("orders_dim", 0.0): 3, ("orders_dim", 0.1): 9, ("part_dim", 0.0): 0, ("part_dim", 0.1): 2, ("line_flags", 0.0): 0, ("line_flags", 0.1): 0}


@pytest.mark.parametrize("name", sorted(HEADS))
def test_ground_truth_of_fixtures(spark, data, name):
    r = fixtures.relation(spark, f"{data}/sf0.01", name)
    rows, distinct, h = HEADS[name]
    assert r.sizes == (rows, distinct)
    oracle = mining.oracle_of(r)
    assert abs(oracle(r.full) - h) < 1e-5
    for eps in (0.0, 0.1):
        got = mining.mine(r, eps, oracle=oracle)
        assert sum(len(v) for v in got.separators.values()) == SEPARATORS[name, eps]
        assert got.complete_full_mvds
    assert mining.verify(r, 0.1) == [] and mining.self_check(r, 0.1) == []
    r.release()


def test_decompositions_of_fixtures(spark, data):
    want = {"supp_geo": (130, 285, 100, 0), "cust_geo": (155, 335, 125, 0), "orders_exact": (1199, 4772, 1187, 0), "orders_lossy": (188, 376, 1200, 13)}
    for name, (tuples, cells, joined, spurious) in want.items():
        fx, clusters = fixtures.DECOMPOSITIONS[name]
        r = fixtures.relation(spark, f"{data}/sf0.01", fx)
        d = decompose.evaluate(r, clusters)
        assert (d.tuples, d.cells, d.joined, d.spurious) == (tuples, cells, joined, spurious)
        assert decompose.natural_join(r, clusters).count() == joined


# ---- small relations on Spark ----------------------------------------------------------------------------------------


def test_exact_mvd_then_one_tuple_less(spark):
    rows = [(a, b, c) for a in range(2) for b in range(3) for c in range(3)]
    r = sources.from_rows(spark, rows, "abc")
    o = entropy.EntropyOracle(r)
    assert measures.mvd(o, 1, 2, 7) == 0
    assert decompose.evaluate(r, [3, 5]).spurious == 0
    less = sources.from_rows(spark, rows[1:], "abc")
    assert 0 < measures.mvd(entropy.EntropyOracle(less), 1, 2, 7) < 0.2
    assert decompose.evaluate(less, [3, 5]).spurious == 1


def test_xor(spark):
    o = entropy.EntropyOracle(sources.from_rows(spark, [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)], "abc"))
    assert abs(measures.elemental(o, 0, 1, 7) - 1) < 1e-9
    assert measures.snap(measures.conditional(o, 1, 2, 0)) == 0


def test_nulls_are_values_and_copies_count(spark):
    rows = [(None, 1), (None, 1), (None, 2), ("x", None)]
    r = sources.from_rows(spark, rows, "ab")
    assert r.sizes == (4, 3)
    o = entropy.EntropyOracle(r)
    assert abs(o(1) - (2 - 3 * math.log2(3) / 4)) < 1e-9
    d = decompose.evaluate(r, [1, 2])
    assert (d.tuples, d.joined, d.spurious) == (5, 6, 3)
    assert decompose.evaluate(sources.from_rows(spark, [(None, 1, None), ("x", None, 2)], "abc"), [3, 6]).spurious == 0


@pytest.mark.parametrize("rows", [[], [(1, 2, 3)], [(1, 1, 1)] * 5])
def test_degenerate_relations_have_no_entropy(spark, rows):
    r = sources.Relation.of(spark.createDataFrame(rows, "a int, b int, c int"))
    o = entropy.EntropyOracle(r).load_cube()
    assert set(o.known.values()) == {0.0}
    d = decompose.evaluate(r, [3, 6])
    assert (d.joined, d.spurious) == (min(1, len(rows)), 0)


def test_keys_spare_their_supersets(spark):
    r = sources.from_rows(spark, [(i, i % 2, i % 3, 0) for i in range(12)], "abcd")
    o = entropy.EntropyOracle(r, sets_per_job=4).load_cube()
    exact = Exact([(i, i % 2, i % 3, 0) for i in range(12)], 4)
    assert all(abs(h - exact(m)) < 1e-9 for m, h in o.known.items()) and len(o.known) == 16
    assert o.metrics.computed < 15


def test_random_decompositions_against_the_join_itself(spark):
    rng = random.Random(3)
    for clusters in ([3, 6, 12], [3, 5, 6], [7, 14, 9], [3, 12], [3, 6, 12, 9]):
        rows = {tuple(rng.randint(0, 2) for _ in range(4)) for _ in range(20)}
        r = sources.from_rows(spark, rows, "abcd")
        keep = sum(1 << i for i in range(4) if any(c >> i & 1 for c in clusters))
        want = sum(all(any(all(t[i] == u[i] for i in bits.members(c)) for u in rows) for c in clusters) for t in itertools.product(range(3), repeat=4))
        got = decompose.join_size(r, clusters)
        assert got * 3 ** (4 - keep.bit_count()) == want


def test_wide_counts_do_not_overflow(spark):
    r = sources.from_rows(spark, [(i, i, i, i) for i in range(100)], "abcd")
    assert decompose.join_size(r, [1, 2, 4, 8]) == 100**4


def test_jobs(spark):
    r = sources.from_rows(spark, [(i % 3, i % 4, i % 5) for i in range(60)], "abc")
    jobs = decompose.DecompositionJobs(r, workers=2, keep=2)
    a = jobs.submit([3, 6])
    assert jobs.submit([6, 3]) is a
    assert a.future.result(60) == decompose.evaluate(r, [3, 6]) and a.status == "FINISHED"
    b = jobs.submit([1, 6])
    jobs.cancel(b)
    assert b.status in ("CANCELED", "FINISHED")
    assert jobs.run([1, 6], 60).joined == 60
    for c in ([1, 2, 4], [5, 2], [3, 4]):
        jobs.run(c, 60)
    assert len(jobs.jobs) <= 3
    jobs.stop()


# ---- schemas ---------------------------------------------------------------------------------------------------------


def two_step(a, b):
    """Compatibility in the words of its definition, without the closed form."""

    def look(p, q):
        s, t = p.lhs, q.lhs
        if s == t or s & t == t:
            return s == t, False
        for c in p.components:
            if c & t:
                if (s | c) & t == t:
                    return False, sum(bool(d & (s | c)) for d in q.components) >= 2
                return True, False
        return False, False

    split1, sep1 = look(a, b)
    split2, sep2 = look(b, a)
    return not split1 and not split2 and sep1 and sep2


def random_jd(rng, n):
    while True:
        lhs = rng.randrange(2**n - 1)
        free = bits.members(2**n - 1 & ~lhs)
        if len(free) >= 2:
            cut = [rng.randrange(3) for _ in free]
            parts = [sum(1 << i for i, k in zip(free, cut, strict=True) if k == g) for g in range(3)]
            parts = [p for p in parts if p]
            if len(parts) >= 2:
                return JD(lhs, tuple(sorted(parts)))


def test_compatibility_in_python_and_in_columns(spark):
    rng = random.Random(7)
    pairs = [(random_jd(rng, 5), random_jd(rng, 5)) for _ in range(3000)]
    want = [two_step(a, b) for a, b in pairs]
    assert [schema.compatible(a, b) for a, b in pairs] == want and 0 < sum(want) < 3000
    df = spark.createDataFrame([(i, a.lhs, list(a.components), b.lhs, list(b.components)) for i, (a, b) in enumerate(pairs)], "i int, s bigint, cs array<bigint>, t bigint, ds array<bigint>")
    from pyspark.sql import functions as F

    got = df.select("i", schema.c_compatible(F.col("s"), F.col("cs"), F.col("t"), F.col("ds")).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in got] == want


def test_join_trees_cover_all_attributes_and_run(spark, data):
    r = fixtures.relation(spark, f"{data}/sf0.001", "supp_geo")
    for s in schema.acyclic_schemas(r.n, mining.mine(r, 0.0).full_mvds):
        clusters = s.clusters
        assert sum(1 << i for i in range(r.n) if any(c >> i & 1 for c in clusters)) == r.full
        assert decompose.evaluate(r, clusters).spurious == 0
        assert str(s).splitlines()[0].startswith(("separator", "cluster"))
        assert not any(s.add(d) for d in s.jds[:1])


def test_dependency_objects():
    d = JD(1, (2, 12), 0.5)
    assert d.splits(1, 2) and not d.splits(2, 3) and not d.splits(0, 1)
    assert d.with_component_to_lhs(0) == JD(3, (12,), -1.0)
    assert d.with_component_from_lhs(1) == JD(0, (1, 2, 12), -1.0)
    assert JD(1, (2, 12, 16)).mvds() == [(1, 2), (1, 12), (1, 14)]
    with pytest.raises(ValueError):
        JD(1, (1, 2))
    b = measures.Bounds().cut_upper(0.5).raise_lower(0.2)
    assert b.below(0.5) is True and b.below(0.1) is False and b.below(0.3) is None and not b.exact and b.approximate(0.6)


def test_inference():
    known = [(0, 2, 0.5), (1, 2, 0.25)]
    order = inference.LatticeOrder(known)
    assert order.infer(5, 2) == 0.25 and order.infer(4, 2) == 0.5 and not order.implies(4, 1, 9)
    basis = inference.Basis([(1, 2, 0.25), (0, 4, 0.5)], 5)
    assert basis.infer(1, 2) == 0.25 and basis.infer(1, 6) == 1.0 and basis.infer(1, 8) == math.inf
    assert basis.infer_batch([(1, 24), (1, 30)]) == [0.75, 1.75]


def test_lattices_on_the_driver():
    assert set(lattice.bipartitions(0b10, 4)) == {(2, 1), (2, 4), (2, 5)}
    assert lattice.most_specific_jd(2, 4) == (1, 4, 8)


def test_reports():
    from trellis.plans import report

    assert report.dependencies([(1, 2, 0.25)], names=["a", "b"]) == "{a} ->> {b}  0.250000"
    assert report.join_dependencies([JD(1, (2, 4), 0.5)]) == "{0} | {1} {2}  0.500000"
    assert report.lattice_levels([(1, 1, 2), (0, 0, 2), (0, 0, 1)]) == "0: {} -> {0}  {} -> {1}\n1: {0} -> {1}"
    assert report.runtime({"a": 1, "seconds": 0.5}) == "a        1\nseconds  0.5"


def test_masks():
    assert bits.parse("{4, 9}") == 528 and bits.parse("{}") == 0 and bits.text(528) == "{4, 9}"
    assert bits.span(1, 3) == 6 and bits.next_set(8, 1) == 3 and bits.next_set(1, 1) == -1 and bits.next_unset(7, 0) == 3
    assert bits.without_nth(0b1011, 2) == 0b1001 and bits.bit_string(5, 4) == "1010"
    assert sorted(bits.subsets(5)) == [0, 1, 4, 5] and bits.deposit(3, 0b1010) == 0b1010
    with pytest.raises(ValueError):
        bits.of([5], 5)


# ---- files -----------------------------------------------------------------------------------------------------------


def test_csv_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text('x,y,z\n1, "a,b" ,c\n\n1,q\n2,q,\n')
    r = sources.read_csv(spark, str(tmp_path / "b.csv"), header=True)
    assert r.names == ["x", "y", "z"] and r.rows == 3
    assert {tuple(t) for t in r.df.collect()} >= {("1", "a,b", "c"), ("1", "q", None)}
    (tmp_path / "a.csv").write_text("1,2\n")
    assert [p.rsplit("/", 1)[-1] for p in sources.list_files(spark, str(tmp_path), "*.csv")] == ["a.csv", "b.csv"]
    assert sources.arity(spark, str(tmp_path / "a.csv")) == 2
    assert sources.read_csv(spark, str(tmp_path / "b.csv"), header=True, columns=2).n == 2


def test_sep_files_round_trip(spark, tmp_path):
    jds = [JD(528, (2, 8, 2112, 5540), 8.88e-16), JD(0, (3, 28), 0.25)]
    sepfile.write_sep(spark, str(tmp_path / "s.sep"), 13, jds)
    got = sepfile.read_sep(spark, str(tmp_path / "s.sep")).collect()
    assert sorted(JD(r["lhs"], tuple(r["components"]), r["measure"]) for r in got) == sorted(jds)
    assert [sepfile.parse_line(sepfile.format_line(13, d))[1] for d in jds] == jds
    name = sepfile.sep_name("x.csv", 10, 5, 0.25)
    assert sepfile.threshold_of(name) == 0.25 and sepfile.threshold_of("x") is None
    with pytest.raises(ValueError):
        sepfile.parse_line("nothing")


def test_batches_over_folders(spark, tmp_path):
    rows = "".join(f"{a},{b},{c}\n" for a in range(2) for b in range(2) for c in range(2))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text(rows + "0,0,0\n")
    from trellis.plans import cli

    assert cli.main(["mine", str(tmp_path / "in"), str(tmp_path / "out"), "0,0.2", "--ranges", "2", "--timeouts", "60"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "metrics")).count() == 2
    assert cli.main(["schemas", str(tmp_path / "in" / "t.csv"), str(tmp_path / "out"), str(tmp_path / "schemas")]) == 0
    assert cli.main(["search", str(tmp_path / "in"), str(tmp_path / "found"), "0.2"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "found")).first()["mvds"] is not None
    assert cli.main(["verify", str(tmp_path / "in"), "0.2"]) == 0


def test_cube_in_two_steps_counts_what_one_does(spark):
    rng = random.Random(21)
    for n in (2, 3, 5):
        rows = [tuple(rng.choice([None, 0, 1, 2]) for _ in range(n)) for _ in range(60)]
        r = sources.Relation.of(spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(n))))
        assert sorted(map(repr, entropy.cube_counts(r).collect())) == sorted(map(repr, entropy.grouped_counts(r, range(2**n)).collect()))
        r.release()
        assert not r._kept


def test_jdbc_source(spark):
    url = "jdbc:derby:memory:trellis;create=true"
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, 2.5), (2, None, 2.5)], "k int, v string, w double")
    df.write.jdbc(url, "cells", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    r = sources.read_jdbc(spark, url, 'SELECT "k", "v", "w" FROM cells WHERE "k" > 0', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert [c.lower() for c in r.names] == ["k", "v", "w"] and r.sizes == (3, 2)
    assert sorted(map(tuple, r.df.collect())) == [(1, "x", 2.5), (2, None, 2.5), (2, None, 2.5)]


def slow_relation(spark):
    """A relation whose scan takes half a minute."""
    import time

    def sleep(batches):
        for b in batches:
            time.sleep(30)
            yield b

    return sources.Relation.of(spark.range(0, 8, 1, 8).mapInArrow(sleep, "id long").selectExpr("id a", "id % 2 b", "id % 3 c"))


def test_timeouts_end_a_run_in_the_middle_of_a_job(spark):
    import time

    for run in (lambda r: not mining.mine(r, 0.1, timeout=2).complete_separators, lambda r: not mining.search_mvds(r, 0.1, timeout=2).complete, lambda r: list(mining.enumerate_schemas(r, [JD(1, (2, 4), 0.0)], timeout=2)) == []):
        began = time.monotonic()
        assert run(slow_relation(spark))
        assert time.monotonic() - began < 20


def test_a_result_after_a_cancel_changes_nothing(spark):
    r = sources.Relation.of(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"))
    jobs = decompose.DecompositionJobs(r)
    job = decompose.Job((1, 2), "tag")
    job.ended.set()
    jobs.cancel(job)
    assert not jobs._end(job, "FINISHED", lambda: job.future.set_result(None)) and job.status == "CANCELED"
    jobs.stop()


def test_adding_nested_dependencies():
    inner, outer = JD(0b0001, (0b0010, 0b1100), 0.0), JD(0b0101, (0b0010, 0b1000), 0.0)
    s = schema.AcyclicSchema(4, [inner])
    assert schema.compatible(inner, outer, True) and not schema.compatible(inner, outer)
    assert not s.add(outer) and s.add(outer, allow_nested=True)
