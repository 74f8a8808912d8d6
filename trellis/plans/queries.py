"""The registered queries of the mining engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import combinatorics, decompose, entropy, inference, lattice, measures, schema, search
from ..operators.measures import JD
from ..sources import sepfile
from ..sources.relation import read_csv
from . import mining
from .fixtures import DECOMPOSITIONS, RELATIONS, arity, relation, release

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return put


def _rows(spark: SparkSession, rows, schema_: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema_)


def _six(x: float) -> float:
    return round(x, 6) + 0.0


# ---- SQL parts -------------------------------------------------------------------------------------------------------


def _columns(n: int) -> str:
    return ", ".join(f"a{i}" for i in range(n))


def sql_relation(fx: str) -> str:
    return f"r({_columns(arity(fx))}) AS MATERIALIZED ({RELATIONS[fx][1]})"


def sql_entropies(fx: str) -> str:
    """CTEs r and e(m, h): the entropies of all attribute sets."""
    n = arity(fx)
    back = ", ".join(f"a{i}" for i in reversed(range(n)))
    return f"""{sql_relation(fx)}, nn AS (SELECT count(*)::DOUBLE n FROM r),
c AS (SELECT {2**n - 1} - grouping({back}) AS mask, count(*)::DOUBLE c FROM r GROUP BY CUBE({back})),
e AS MATERIALIZED (SELECT mask::BIGINT m, greatest(0, log2(max(n)) - sum(c * log2(c)) / max(n)) h FROM c, nn GROUP BY mask)"""


def sql_mvds(fx: str) -> str:
    """CTE mvd(s, y, i): all MVDs, both orders of each split."""
    full = 2 ** arity(fx) - 1
    return f"""mvd AS MATERIALIZED (SELECT s.m s, y.m y, ey.h + ez.h - s.h - f.h i FROM e s JOIN e y ON (s.m & y.m) = 0 AND y.m > 0 JOIN e f ON f.m = {full}
JOIN e ey ON ey.m = (s.m | y.m) JOIN e ez ON ez.m = ({full} & ~y.m) WHERE (s.m | y.m) <> {full})"""


def _partitions(items: list[int]) -> Iterator[list[int]]:
    """All partitions of a list of attributes into masks."""
    if not items:
        yield []
        return
    first, rest = 1 << items[0], items[1:]
    for p in _partitions(rest):
        yield [first, *p]
        for k in range(len(p)):
            yield [*p[:k], p[k] | first, *p[k + 1 :]]


def sql_full_mvds(fx: str, eps: float) -> str:
    """CTE fm(lhs, cs, j): JDs over minimal separators that hold and of which no finer one holds."""
    n = arity(fx)
    full = 2**n - 1
    cands = [(s, sorted(p)) for s in range(full) for p in _partitions(bits.members(full & ~s)) if len(p) > 1]
    values = ",".join(f"({s}::BIGINT,{p}::BIGINT[])" for s, p in cands)
    return f"""{sql_mvds(fx)}, {sql_separators(n, eps)}, ss AS (SELECT DISTINCT s FROM minsep), cand(lhs, cs) AS (VALUES {values}),
jx AS (SELECT lhs, cs, unnest(cs) c FROM cand WHERE lhs IN (SELECT s FROM ss)),
jm AS MATERIALIZED (SELECT lhs, cs, greatest(0, sum(ec.h) - (len(cs) - 1) * max(el.h) - max(ef.h)) j FROM jx JOIN e ec ON ec.m = (lhs | c) JOIN e el ON el.m = lhs JOIN e ef ON ef.m = {full} GROUP BY lhs, cs),
jok AS (SELECT * FROM jm WHERE j <= {eps} + 1e-5),
fm AS MATERIALIZED (SELECT * FROM jok a WHERE NOT EXISTS (SELECT 1 FROM jok b WHERE b.lhs = a.lhs AND len(b.cs) > len(a.cs)
  AND len(list_filter(b.cs, lambda c: len(list_filter(a.cs, lambda d: (c & d) = c)) > 0)) = len(b.cs)))"""


def sql_separators(n: int, eps: float) -> str:
    """CTE minsep(x, z, s) from mvd."""
    return f"""ok AS (SELECT * FROM mvd WHERE i <= {eps} + 1e-5),
p AS (SELECT x.range x, z.range z FROM range(0, {n}) x, range(0, {n}) z WHERE x.range < z.range),
sep AS MATERIALIZED (SELECT DISTINCT p.x, p.z, s FROM ok, p WHERE ((y >> p.x) & 1) = 1 AND ((y >> p.z) & 1) = 0 AND ((s >> p.z) & 1) = 0),
minsep AS MATERIALIZED (SELECT DISTINCT x, z, s FROM sep a WHERE NOT EXISTS (SELECT 1 FROM sep b WHERE a.x = b.x AND a.z = b.z AND b.s <> a.s AND (b.s & a.s) = b.s))"""


def _tag(eps: float) -> str:
    return str(eps).replace(".", "_").removesuffix("_0")


_TEXT = "array_to_string(list_transform({0}, lambda c: c::VARCHAR), '|')"


def _text(components: str = "components"):
    return F.array_join(F.transform(components, lambda c: c.cast("string")), "|")


# ---- entropies and counts --------------------------------------------------------------------------------------------

for _fx in RELATIONS:
    _n = arity(_fx)

    @add(f"entropy_cube_{_fx}", f"WITH {sql_entropies(_fx)} SELECT m AS mask, round(h, 6) + 0.0 AS h FROM e")
    def _(spark, sf, fx=_fx):
        return entropy.cube(relation(spark, sf, fx)).select("mask", measures.rounded(F.col("h")).alias("h"))

    @add(f"entropy_single_columns_{_fx}", f"WITH {sql_entropies(_fx)} SELECT m AS mask, round(h, 6) + 0.0 AS h FROM e WHERE bit_count(m) = 1")
    def _(spark, sf, fx=_fx):
        r = relation(spark, sf, fx)
        return entropy.entropies(r, [1 << i for i in range(r.n)]).select("mask", measures.rounded(F.col("h")).alias("h"))

    @add(f"distinct_rows_{_fx}", f"WITH {sql_relation(_fx)} SELECT (SELECT count(*) FROM r)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM r))::BIGINT AS n_distinct")
    def _(spark, sf, fx=_fx):
        w = relation(spark, sf, fx).weighted
        return w.agg(F.sum("w").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))

_MASKS = [0b00001, 0b00110, 0b01011, 0b11110]


@add("entropy_batch_orders_dim", f"WITH {sql_entropies('orders_dim')} SELECT m AS mask, round(h, 6) + 0.0 AS h FROM e WHERE m IN ({', '.join(map(str, _MASKS))})")
def _(spark, sf):
    return entropy.entropies(relation(spark, sf, "orders_dim"), _MASKS).select("mask", measures.rounded(F.col("h")).alias("h"))


@add("entropy_most_specific_orders_dim", f"WITH {sql_entropies('orders_dim')} SELECT m AS mask, round(h, 6) + 0.0 AS h FROM e WHERE bit_count(m) >= 3 OR m = 0")
def _(spark, sf):
    return entropy.EntropyOracle(relation(spark, sf, "orders_dim")).load_most_specific().table().select("mask", measures.rounded(F.col("h")).alias("h"))


@add("entropy_ranges_line_flags", f"WITH {sql_entropies('line_flags')} SELECT m AS mask, round(h, 6) + 0.0 AS h FROM e WHERE (m & 56) = 0 OR (m & 7) = 0")
def _(spark, sf):
    return entropy.EntropyOracle(relation(spark, sf, "line_flags")).load_ranges(3).table().select("mask", measures.rounded(F.col("h")).alias("h"))


_DUPS = " UNION ALL ".join(f"SELECT {i} AS attribute, a{i}::VARCHAR AS value, count(*)::BIGINT AS c FROM r GROUP BY a{i} HAVING count(*) > 1" for i in range(5))


@add("value_counts_dups", f"WITH {sql_relation('cust_geo')} {_DUPS}")
def _(spark, sf):
    return entropy.repeated_values(relation(spark, sf, "cust_geo"))


@add("group_counts_dups", f"WITH {sql_relation('orders_dim')} SELECT a0 AS status, a2::INT AS y, count(*)::BIGINT AS c FROM r GROUP BY a0, a2 HAVING count(*) > 1")
def _(spark, sf):
    counts = entropy.grouped_counts(relation(spark, sf, "orders_dim"), [0b00101])
    return counts.where("c > 1").select(F.col("a0").alias("status"), F.col("a2").alias("y"), "c")


for _fx in ("cust_geo", "orders_dim", "part_dim"):
    # prices in a text that both sides write alike
    _value = {i: f"a{i}::DECIMAL(18, 6)::VARCHAR" if (_fx, i) == ("part_dim", 3) else f"a{i}::VARCHAR" for i in range(arity(_fx))}
    _union = " UNION ALL ".join(f"SELECT DISTINCT {i} AS attribute, {_value[i]} AS value, (dense_rank() OVER (ORDER BY a{i} NULLS FIRST))::BIGINT AS code FROM r" for i in range(arity(_fx)))

    @add(f"dictionary_encode_{_fx}", f"WITH {sql_relation(_fx)} {_union}")
    def _(spark, sf, fx=_fx):
        codes = relation(spark, sf, fx).codes()
        price = (F.col("attribute") == 3) & F.lit(fx == "part_dim")
        return codes.withColumn("value", F.when(price, F.col("value").try_cast("decimal(18, 6)").cast("string")).otherwise(F.col("value")))


_ENC = ", ".join(f"(dense_rank() OVER (ORDER BY a{i} NULLS FIRST))::BIGINT AS a{i}" for i in range(4))


@add("encoded_relation_nation_region", f"WITH {sql_relation('nation_region')} SELECT {_ENC} FROM r")
def _(spark, sf):
    return relation(spark, sf, "nation_region").encoded()


@add("singleton_groups_part_dim", f"WITH {sql_relation('part_dim')} SELECT a0 AS brand, a2 AS size, count(*)::BIGINT AS c FROM r GROUP BY a0, a2 HAVING count(*) = 1")
def _(spark, sf):
    counts = entropy.grouped_counts(relation(spark, sf, "part_dim"), [0b0101])
    return counts.where("c = 1").select(F.col("a0").alias("brand"), F.col("a2").alias("size"), "c")


# ---- measures --------------------------------------------------------------------------------------------------------


def _table(spark, sf, fx) -> DataFrame:
    return entropy.cube(relation(spark, sf, fx)).select("mask", "h")


@add("fd_measures", f"WITH {sql_entropies('orders_dim')} SELECT x.m AS lhs, (1::BIGINT << a.range) AS rhs, round(xy.h - x.h, 6) + 0.0 AS measure FROM e x, range(0, 5) a JOIN e xy ON xy.m = (x.m | (1::BIGINT << a.range)) WHERE ((x.m >> a.range) & 1) = 0")
def _(spark, sf):
    h = _table(spark, sf, "orders_dim")
    lhs = spark.range(32).select(F.col("id").alias("lhs"))
    fds = lhs.select("lhs", F.explode(bits.c_members(bits.c_complement(F.col("lhs"), 5), 5)).alias("i")).select("lhs", bits.bit(F.col("i")).alias("rhs"))
    return measures.fd_measures(fds, h).select("lhs", "rhs", measures.rounded(F.col("measure")).alias("measure"))


@add("mvd_measures", f"WITH {sql_entropies('orders_dim')}, {sql_mvds('orders_dim')} SELECT s AS lhs, y AS rhs, round(i, 6) + 0.0 AS measure FROM mvd WHERE y < (31 & ~s & ~y)")
def _(spark, sf):
    got = measures.mvd_measures(lattice.mvd_candidates(spark, 5), _table(spark, sf, "orders_dim"), 31)
    return got.select("lhs", "rhs", measures.rounded(F.col("measure")).alias("measure"))


for _fx in RELATIONS:
    _n, _full = arity(_fx), 2 ** arity(_fx) - 1

    @add(f"elemental_mi_{_fx}", f"WITH {sql_entropies(_fx)}, {sql_mvds(_fx)} SELECT x.range::INT AS x, z.range::INT AS y, round(i, 6) + 0.0 AS measure FROM mvd, range(0, {_n}) x, range(0, {_n}) z WHERE x.range < z.range AND y = (1 << x.range) AND s = ({_full} & ~(1 << x.range) & ~(1 << z.range))")
    def _(spark, sf, fx=_fx, n=_n):
        i = spark.range(n).select(F.col("id").cast("int").alias("x"))
        pairs = i.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("x < y")
        got = measures.elemental_measures(pairs, _table(spark, sf, fx), 2**n - 1)
        return got.select("x", "y", measures.rounded(F.col("measure")).alias("measure"))


_CMI = "SELECT a.m AS a, b.m AS b, s.m AS s, round(sa.h + sb.h - s.h - sab.h, 6) + 0.0 AS measure FROM e a, e b, e s JOIN e sa ON sa.m = (s.m | a.m) JOIN e sb ON sb.m = (s.m | b.m) JOIN e sab ON sab.m = (s.m | a.m | b.m) WHERE a.m > 0 AND b.m > a.m AND (a.m & b.m) = 0 AND (a.m & s.m) = 0 AND (b.m & s.m) = 0"


@add("conditional_mi", f"WITH {sql_entropies('nation_region')} {_CMI}")
def _(spark, sf):
    rows = [(a, b, s) for a in range(1, 16) for b in range(a + 1, 16) if not a & b for s in bits.subsets(15 & ~a & ~b)]
    got = measures.conditional_measures(_rows(spark, rows, "a bigint, b bigint, s bigint"), _table(spark, sf, "nation_region"))
    return got.select("a", "b", "s", measures.rounded(F.col("measure")).alias("measure"))


_JDS = [(0b01000, [0b00011, 0b10000, 0b00100]), (0, [0b00001, 0b00010, 0b00100, 0b11000]), (0b00001, [0b00010, 0b11100])]
_JVALUES = ", ".join(f"({s}::BIGINT, {c}::BIGINT[])" for s, c in _JDS)


@add("jd_measure", f"WITH {sql_entropies('orders_dim')}, d(lhs, cs) AS (VALUES {_JVALUES}), x AS (SELECT lhs, cs, unnest(cs) c FROM d) SELECT lhs, {_TEXT.format('cs')} AS components, round(greatest(0, sum(ec.h) - (len(cs) - 1) * max(el.h) - max(ef.h)), 6) + 0.0 AS measure FROM x JOIN e ec ON ec.m = (lhs | c) JOIN e el ON el.m = lhs JOIN e ef ON ef.m = 31 GROUP BY lhs, cs")
def _(spark, sf):
    got = measures.jd_measures(_rows(spark, _JDS, "lhs bigint, components array<bigint>"), _table(spark, sf, "orders_dim"), 31)
    return got.select("lhs", _text().alias("components"), measures.rounded(F.col("measure")).alias("measure"))


@add("measure_bounds", f"WITH {sql_entropies('orders_dim')} SELECT x.m AS lhs, (1::BIGINT << a.range) AS rhs, CASE WHEN xy.h - x.h < 1e-7 THEN 'exact' WHEN xy.h - x.h <= 0.5 + 1e-5 THEN 'approximate' ELSE 'no' END AS status FROM e x, range(0, 5) a JOIN e xy ON xy.m = (x.m | (1::BIGINT << a.range)) WHERE ((x.m >> a.range) & 1) = 0")
def _(spark, sf):
    h = _table(spark, sf, "orders_dim")
    lhs = spark.range(32).select(F.col("id").alias("lhs"))
    fds = lhs.select("lhs", F.explode(bits.c_members(bits.c_complement(F.col("lhs"), 5), 5)).alias("i")).select("lhs", bits.bit(F.col("i")).alias("rhs"))
    m = F.col("measure")
    return measures.fd_measures(fds, h).select("lhs", "rhs", F.when(m < measures.SNAP, "exact").when(measures.holds(m, 0.5), "approximate").otherwise("no").alias("status"))


# ---- lattices --------------------------------------------------------------------------------------------------------


@add("saturated_fds", "SELECT (31 & ~(1 << i.range))::BIGINT AS lhs, (1 << i.range)::BIGINT AS rhs FROM range(0, 5) i")
def _(spark, sf):
    return lattice.saturated_fds(spark, 5)


@add("general_fds", "SELECT 0::BIGINT AS lhs, (1 << i.range)::BIGINT AS rhs FROM range(0, 5) i")
def _(spark, sf):
    return lattice.general_fds(spark, 5)


@add("general_mvds", "SELECT 0::BIGINT AS lhs, s.range AS rhs FROM range(1, 32) s WHERE bit_count(s.range) <= 3")
def _(spark, sf):
    return lattice.general_mvds(spark, 5)


@add("most_specific_mvds", "SELECT (31 & ~(1 << i.range) & ~(1 << j.range))::BIGINT AS lhs, (1 << i.range)::BIGINT AS rhs FROM range(0, 5) i, range(0, 5) j WHERE i.range < j.range")
def _(spark, sf):
    return lattice.specific_mvds(spark, 5)


_DEPS = [(0b00001, 0b00010), (0b00101, 0b01000), (0, 0b00011), (0b01100, 0b10001)]
_DVALUES = "d(lhs, rhs) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in _DEPS) + ")"
_EACH = "d, range(0, 5) b"


def _deps(spark) -> DataFrame:
    return _rows(spark, _DEPS, "lhs bigint, rhs bigint")


@add("fd_specializations", f"WITH {_DVALUES} SELECT DISTINCT (lhs | (1 << b.range))::BIGINT AS lhs, rhs FROM {_EACH} WHERE (((lhs | rhs) >> b.range) & 1) = 0")
def _(spark, sf):
    return lattice.fd_specializations(_deps(spark), 5)


@add("fd_generalizations", f"WITH {_DVALUES} SELECT DISTINCT (lhs & ~(1 << b.range))::BIGINT AS lhs, rhs FROM {_EACH} WHERE ((lhs >> b.range) & 1) = 1")
def _(spark, sf):
    return lattice.fd_generalizations(_deps(spark), 5)


@add("mvd_specializations", f"WITH {_DVALUES} SELECT DISTINCT (lhs | (1 << b.range))::BIGINT AS lhs, (rhs & ~(1 << b.range))::BIGINT AS rhs FROM {_EACH} WHERE ((lhs >> b.range) & 1) = 0 AND (rhs & ~(1 << b.range)) <> 0")
def _(spark, sf):
    return lattice.mvd_specializations(_deps(spark), 5)


@add("mvd_generalizations", f"WITH {_DVALUES} SELECT DISTINCT (lhs & ~(1 << b.range))::BIGINT AS lhs, unnest([rhs, (rhs | (1 << b.range))::BIGINT]) AS rhs FROM {_EACH} WHERE ((lhs >> b.range) & 1) = 1")
def _(spark, sf):
    return lattice.mvd_generalizations(_deps(spark), 5)


@add("lattice_fd_levels", "SELECT bit_count(x.range)::INT AS level, x.range AS lhs, (1 << a.range)::BIGINT AS rhs FROM range(0, 16) x, range(0, 4) a WHERE ((x.range >> a.range) & 1) = 0")
def _(spark, sf):
    return lattice.levels(spark, lattice.general_fds(spark, 4), lattice.fd_specializations, 4)


@add("lattice_mvd_levels", "SELECT bit_count(x.range)::INT AS level, x.range AS lhs, y.range AS rhs FROM range(0, 16) x, range(1, 16) y WHERE (x.range & y.range) = 0 AND (bit_count(x.range) > 0 OR bit_count(y.range) <= 3) AND bit_count(y.range) <= 3")
def _(spark, sf):
    return lattice.levels(spark, lattice.general_mvds(spark, 4), lattice.mvd_specializations, 4)


@add("candidates_mvd_n5", "SELECT s.range AS lhs, y.range AS rhs FROM range(0, 31) s, range(1, 32) y WHERE (s.range & y.range) = 0 AND y.range < (31 & ~s.range & ~y.range)")
def _(spark, sf):
    return lattice.mvd_candidates(spark, 5)


@add("candidates_of_lhs_n6", "SELECT 34::BIGINT AS lhs, y.range AS rhs FROM range(1, 64) y WHERE (34 & y.range) = 0 AND y.range < (63 & ~34 & ~y.range)")
def _(spark, sf):
    return _rows(spark, lattice.bipartitions(0b100010, 6), "lhs bigint, rhs bigint")


@add("jd_to_mvds", "SELECT 1::BIGINT AS lhs, '2|12|16' AS components, unnest([2, 12, 14])::BIGINT AS rhs UNION ALL SELECT 0::BIGINT, '3|28', 3::BIGINT")
def _(spark, sf):
    jds = _rows(spark, [(1, [2, 12, 16]), (0, [3, 28])], "lhs bigint, components array<bigint>")
    return lattice.jd_to_mvds(jds).select("lhs", _text().alias("components"), "rhs")


# ---- searches --------------------------------------------------------------------------------------------------------

for _fx in RELATIONS:
    _n, _full = arity(_fx), 2 ** arity(_fx) - 1
    for _eps in (0.0, 0.1):
        _id = f"{_fx}_eps{_tag(_eps)}"

        @add(f"fd_minimal_{_id}", f"""WITH {sql_entropies(_fx)}, f AS (SELECT x.m AS lhs, (1::BIGINT << a.range) AS rhs, xy.h - x.h AS m FROM e x, range(0, {_n}) a JOIN e xy ON xy.m = (x.m | (1::BIGINT << a.range)) WHERE ((x.m >> a.range) & 1) = 0),
ok AS (SELECT * FROM f WHERE m <= {_eps} + 1e-5) SELECT lhs, rhs, round(m, 6) + 0.0 AS measure FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.rhs = a.rhs AND b.lhs <> a.lhs AND (b.lhs & a.lhs) = b.lhs)""")
        def _(spark, sf, fx=_fx, eps=_eps):
            found = search.minimal_fds(mining.oracle_of(relation(spark, sf, fx)), eps)
            return _rows(spark, [(x, y, _six(m)) for x, y, m in found], "lhs bigint, rhs bigint, measure double")

        @add(f"min_separators_{_id}", f"WITH {sql_entropies(_fx)}, {sql_mvds(_fx)}, {sql_separators(_n, _eps)} SELECT x::INT AS x, z::INT AS y, s AS separator FROM minsep")
        def _(spark, sf, fx=_fx, eps=_eps):
            return mining.separator_rows(spark, mining.mine(relation(spark, sf, fx), eps, with_full_mvds=False))

        @add(f"full_mvds_{_id}", f"WITH {sql_entropies(_fx)}, {sql_full_mvds(_fx, _eps)} SELECT lhs, {_TEXT.format('cs')} AS components, round(j, 6) + 0.0 AS measure FROM fm")
        def _(spark, sf, fx=_fx, eps=_eps):
            found = mining.mine(relation(spark, sf, fx), eps)
            return mining.jd_rows(spark, found.full_mvds).select("lhs", _text().alias("components"), "measure")

        _all = f"""WITH {sql_entropies(_fx)}, {sql_mvds(_fx)} SELECT s AS lhs, y AS rhs, round(i, 6) + 0.0 AS measure FROM mvd WHERE y < ({_full} & ~s & ~y) AND i <= {_eps} + 1e-5
UNION ALL SELECT x.m, ({_full} & ~x.m)::BIGINT, round(f.h - x.h, 6) + 0.0 FROM e x JOIN e f ON f.m = {_full} WHERE bit_count(x.m) = {_n - 1} AND f.h - x.h <= {_eps} + 1e-5"""

        @add(f"mvd_all_{_id}", _all)
        def _(spark, sf, fx=_fx, eps=_eps):
            found = search.all_mvds(mining.oracle_of(relation(spark, sf, fx)), eps)
            return _rows(spark, [(x, y, _six(m)) for x, y, m in found], "lhs bigint, rhs bigint, measure double")

        @add(f"mvd_bruteforce_{_id}", _all)
        def _(spark, sf, fx=_fx, eps=_eps):
            n = arity(fx)
            got = search.brute_force(_table(spark, sf, fx), n, eps, 2**n - 1)
            return got.select("lhs", "rhs", measures.rounded(F.col("measure")).alias("measure"))

        @add(f"mvd_topdown_{_id}", f"""WITH {sql_entropies(_fx)}, {sql_mvds(_fx)}, ok AS MATERIALIZED (SELECT * FROM mvd WHERE i <= {_eps} + 1e-5) SELECT s AS lhs, y AS rhs, round(i, 6) + 0.0 AS measure FROM ok a
WHERE y < ({_full} & ~s & ~y) AND NOT EXISTS (SELECT 1 FROM ok b WHERE b.s <> a.s AND (b.s & a.s) = b.s AND (b.y & ~a.s) = a.y)""")
        def _(spark, sf, fx=_fx, eps=_eps):
            found = search.minimal_mvds(mining.oracle_of(relation(spark, sf, fx)), eps)
            return _rows(spark, [(x, y, _six(m)) for x, y, m in found], "lhs bigint, rhs bigint, measure double")


_KNOWN = [(0b00001, 0b00010, 0.25), (0, 0b00010, 0.5), (0b00101, 0b01000, 0.1)]
_ASKED = [(0b00101, 0b00010), (0b00100, 0b00010), (0b10101, 0b01000), (0b10000, 0b01000)]
_KV = "k(kl, kr, m) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, {m}::DOUBLE)" for a, b, m in _KNOWN) + ")"
_AV = "q(lhs, rhs) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in _ASKED) + ")"


@add("lattice_inference", f"WITH {_KV}, {_AV} SELECT lhs, rhs, min(m) AS upper FROM q LEFT JOIN k ON rhs = kr AND (lhs & kl) = kl GROUP BY lhs, rhs")
def _(spark, sf):
    return search.implied(_rows(spark, _ASKED, "lhs bigint, rhs bigint"), _rows(spark, _KNOWN, "lhs bigint, rhs bigint, measure double"))


@add("dependency_lookup", f"WITH {_KV}, {_AV} SELECT q.lhs, q.rhs, EXISTS (SELECT 1 FROM k WHERE kr = q.rhs AND kl = q.lhs) AS known FROM q")
def _(spark, sf):
    asked, known = _rows(spark, _ASKED, "lhs bigint, rhs bigint"), _rows(spark, _KNOWN, "lhs bigint, rhs bigint, measure double")
    there = asked.join(known, ["lhs", "rhs"], "left_semi").withColumn("known", F.lit(True))
    return there.unionByName(asked.join(known, ["lhs", "rhs"], "left_anti").withColumn("known", F.lit(False)))


@add("dependency_basis", "SELECT * FROM (VALUES (2::BIGINT, 0.25::DOUBLE), (4::BIGINT, 0.75::DOUBLE), (24::BIGINT, 0.75::DOUBLE)) t(block, bound)")
def _(spark, sf):
    blocks = inference.dependency_basis(1, [(1, 2, 0.25), (0, 4, 0.5)], 5)
    return _rows(spark, sorted(blocks.items()), "block bigint, bound double")


# ---- graphs and schemas ----------------------------------------------------------------------------------------------

_EDGES = [0b001010, 0b110101, 0b010000, 0b001100, 0b010001, 0b001111]
_HIT = " AND ".join(f"(t.range & {e}) <> 0" for e in _EDGES)


@add("min_transversals", f"WITH h AS (SELECT t.range AS t FROM range(0, 64) t WHERE {_HIT}) SELECT t AS transversal FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.t <> a.t AND (b.t & a.t) = b.t)")
def _(spark, sf):
    return _rows(spark, [(t,) for t in combinatorics.Transversals(_EDGES)], "transversal bigint")


_GRAPH = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5)]
_NOEDGE = " AND ".join(f"(t.range & {1 << a | 1 << b}) <> {1 << a | 1 << b}" for a, b in _GRAPH)


@add("maximal_independent_sets", f"WITH h AS (SELECT t.range AS t FROM range(0, 64) t WHERE {_NOEDGE}) SELECT t AS nodes FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.t <> a.t AND (b.t & a.t) = a.t)")
def _(spark, sf):
    return _rows(spark, [(s,) for s in combinatorics.Graph(6, _GRAPH).maximal_independent_sets()], "nodes bigint")


@add("attribute_components", "SELECT unnest([7, 24, 32])::BIGINT AS component")
def _(spark, sf):
    return _rows(spark, [(c,) for c in combinatorics.connected_components(6, [(0, 1), (1, 2), (3, 4)])], "component bigint")


def _mined(spark, sf, fx, eps) -> list[JD]:
    return mining.mine(relation(spark, sf, fx), eps).full_mvds


_FITS = "len(list_filter({cs}, lambda c: (({s} | c) & {t}) = {t} AND len(list_filter({ds}, lambda d: (d & ({s} | c)) <> 0)) >= 2)) > 0"
_COMPATIBLE = f"((a.lhs & b.lhs) <> a.lhs AND (a.lhs & b.lhs) <> b.lhs AND {_FITS.format(s='a.lhs', cs='a.cs', t='b.lhs', ds='b.cs')} AND {_FITS.format(s='b.lhs', cs='b.cs', t='a.lhs', ds='a.cs')})"
_NUMBERED = f"numbered AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY lhs, cs) - 1)::INT AS id, lhs, cs, j, lhs || ':' || {_TEXT.format('cs')} AS name FROM fm)"

for _fx, _eps in (("supp_geo", 0.0), ("cust_geo", 0.0), ("orders_dim", 0.1)):
    _id = f"{_fx}_eps{_tag(_eps)}"

    @add(f"jd_conflicts_{_id}", f"WITH {sql_entropies(_fx)}, {sql_full_mvds(_fx, _eps)}, {_NUMBERED} SELECT a.name AS a, b.name AS b FROM numbered a JOIN numbered b ON a.id < b.id WHERE NOT {_COMPATIBLE}")
    def _(spark, sf, fx=_fx, eps=_eps):
        rows = [(i, d.lhs, list(d.components)) for i, d in enumerate(_mined(spark, sf, fx, eps))]
        jds = _rows(spark, rows, "id int, lhs bigint, components array<bigint>")
        names = jds.select("id", F.concat(F.col("lhs").cast("string"), F.lit(":"), _text()).alias("name"))
        got = schema.conflicts(jds).join(names.withColumnRenamed("id", "a").withColumnRenamed("name", "na"), "a").join(names.withColumnRenamed("id", "b").withColumnRenamed("name", "nb"), "b")
        return got.select(F.col("na").alias("a"), F.col("nb").alias("b"))

    @add(f"acyclic_schemas_{_id}", f"""WITH {sql_entropies(_fx)}, {sql_full_mvds(_fx, _eps)}, {_NUMBERED}, k AS (SELECT count(*) AS k FROM numbered),
conf AS MATERIALIZED (SELECT (1::BIGINT << a.id) | (1::BIGINT << b.id) AS e FROM numbered a JOIN numbered b ON a.id < b.id WHERE NOT {_COMPATIBLE}),
ind AS MATERIALIZED (SELECT t.range AS t FROM k, range(0, (1::BIGINT << (SELECT k FROM k))::BIGINT) t WHERE NOT EXISTS (SELECT 1 FROM conf WHERE (e & t.range) = e)),
mis AS (SELECT t FROM ind a WHERE NOT EXISTS (SELECT 1 FROM ind b WHERE b.t <> a.t AND (b.t & a.t) = a.t))
SELECT string_agg(name, ';' ORDER BY id) AS jds, count(*)::BIGINT AS n_jds, round(sum(j), 6) + 0.0 AS measure FROM mis JOIN numbered ON ((t >> id) & 1) = 1 GROUP BY t""")
    def _(spark, sf, fx=_fx, eps=_eps):
        r = relation(spark, sf, fx)
        found = list(schema.acyclic_schemas(r.n, _mined(spark, sf, fx, eps)))
        rows = [(";".join(f"{d.lhs}:{'|'.join(map(str, d.components))}" for d in sorted(s.jds)), len(s.jds), _six(s.measure)) for s in found]
        return _rows(spark, rows, "jds string, n_jds bigint, measure double")

    @add(f"join_tree_{_id}")
    def _(spark, sf, fx=_fx, eps=_eps):
        r = relation(spark, sf, fx)
        return mining.tree_rows(spark, schema.acyclic_schemas(r.n, _mined(spark, sf, fx, eps)))

    @add(f"schema_metrics_{_id}")
    def _(spark, sf, fx=_fx, eps=_eps):
        r = relation(spark, sf, fx)
        rows = [(i, len(j.schema.clusters), j.schema.largest_cluster, j.schema.largest_separator, j.decomposition.tuples, j.decomposition.cells, j.decomposition.spurious) for i, j in enumerate(mining.enumerate_schemas(r, mining.mine(r, eps).full_mvds))]
        return _rows(spark, rows, "schema_id int, clusters int, largest_cluster int, largest_separator int, tuples bigint, cells bigint, spurious bigint")


def _schemas(spark, sf, fx, eps) -> list[schema.AcyclicSchema]:
    return list(schema.acyclic_schemas(arity(fx), _mined(spark, sf, fx, eps)))


def _named(s: schema.AcyclicSchema) -> str:
    return ";".join(f"{d.lhs}:{'|'.join(map(str, d.components))}" for d in sorted(s.jds))


def sql_schemas(fx: str, eps: float) -> str:
    """CTEs sch(t, jds): the acyclic schemas, as sets of numbered JDs; top(t, m): their clusters, which are the largest attribute
    sets that no JD of the schema takes apart; g(m, n): the number of distinct tuples of each attribute set."""
    n = arity(fx)
    back = ", ".join(f"a{i}" for i in reversed(range(n)))
    return f"""{sql_entropies(fx)}, {sql_full_mvds(fx, eps)}, {_NUMBERED}, k AS (SELECT count(*) AS k FROM numbered),
conf AS MATERIALIZED (SELECT (1::BIGINT << a.id) | (1::BIGINT << b.id) AS e FROM numbered a JOIN numbered b ON a.id < b.id WHERE NOT {_COMPATIBLE}),
ind AS MATERIALIZED (SELECT t.range AS t FROM k, range(0, (1::BIGINT << (SELECT k FROM k))::BIGINT) t WHERE NOT EXISTS (SELECT 1 FROM conf WHERE (e & t.range) = e)),
mis AS MATERIALIZED (SELECT t FROM ind a WHERE NOT EXISTS (SELECT 1 FROM ind b WHERE b.t <> a.t AND (b.t & a.t) = a.t)),
sch AS MATERIALIZED (SELECT t, string_agg(name, ';' ORDER BY id) AS jds, max(bit_count(lhs))::INT AS largest_separator FROM mis JOIN numbered ON ((t >> id) & 1) = 1 GROUP BY t),
apart AS MATERIALIZED (SELECT id, m.range::BIGINT AS m FROM numbered, range(1, {2**n}) m WHERE len(list_filter(cs, lambda c: (c & m.range) <> 0)) > 1),
whole AS MATERIALIZED (SELECT t, m.range::BIGINT AS m FROM sch, range(1, {2**n}) m WHERE NOT EXISTS (SELECT 1 FROM apart WHERE ((t >> id) & 1) = 1 AND apart.m = m.range)),
top AS MATERIALIZED (SELECT t, m FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.t = a.t AND b.m <> a.m AND (b.m & a.m) = a.m)),
g AS MATERIALIZED (SELECT ({2**n - 1} - grouping({back}))::BIGINT AS m, count(*)::BIGINT AS n FROM (SELECT DISTINCT * FROM r) GROUP BY CUBE({back})),
gs AS MATERIALIZED (SELECT m, count(*)::BIGINT AS n FROM g GROUP BY m),
met AS MATERIALIZED (SELECT jds, count(*)::INT AS clusters, max(bit_count(m))::INT AS largest_cluster, max(largest_separator) AS largest_separator, min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest, sum(n)::BIGINT AS tuples, sum(n * bit_count(m))::BIGINT AS cells FROM sch JOIN top USING (t) JOIN gs USING (m) GROUP BY t, jds)"""


for _fx, _eps in (("supp_geo", 0.0), ("cust_geo", 0.0), ("orders_dim", 0.1)):
    _id = f"{_fx}_eps{_tag(_eps)}"

    @add(f"schema_clusters_{_id}", f"WITH {sql_schemas(_fx, _eps)} SELECT jds, m AS cluster FROM sch JOIN top USING (t)")
    def _(spark, sf, fx=_fx, eps=_eps):
        return _rows(spark, [(_named(s), c) for s in _schemas(spark, sf, fx, eps) for c in s.clusters], "jds string, cluster bigint")

    @add(f"schema_separators_{_id}", f"WITH {sql_schemas(_fx, _eps)} SELECT DISTINCT jds, lhs AS separator FROM sch JOIN numbered ON ((t >> id) & 1) = 1")
    def _(spark, sf, fx=_fx, eps=_eps):
        return _rows(spark, [(_named(s), x) for s in _schemas(spark, sf, fx, eps) for x in s.separators], "jds string, separator bigint")

    @add(f"schema_sizes_{_id}", f"WITH {sql_schemas(_fx, _eps)} SELECT * FROM met")
    def _(spark, sf, fx=_fx, eps=_eps):
        r = relation(spark, sf, fx)
        rows = []
        for j in mining.enumerate_schemas(r, mining.mine(r, eps).full_mvds):
            s, d = j.schema, j.decomposition
            rows.append((_named(s), len(s.clusters), s.largest_cluster, s.largest_separator, d.smallest, d.largest, d.tuples, d.cells))
        return _rows(spark, rows, "jds string, clusters int, largest_cluster int, largest_separator int, smallest bigint, largest bigint, tuples bigint, cells bigint")


@add("schema_best", f"""WITH {sql_schemas("orders_dim", 0.1)} SELECT 'most clusters' AS criterion, jds AS schema_id FROM (SELECT *, rank() OVER (ORDER BY clusters DESC) AS place FROM met) WHERE place = 1
UNION ALL SELECT 'smallest largest cluster', jds FROM (SELECT *, rank() OVER (ORDER BY largest_cluster) AS place FROM met) WHERE place = 1
UNION ALL SELECT 'smallest largest separator', jds FROM (SELECT *, rank() OVER (ORDER BY largest_separator) AS place FROM met) WHERE place = 1""")
def _(spark, sf):
    rows = [(_named(s), len(s.clusters), s.largest_cluster, s.largest_separator) for s in _schemas(spark, sf, "orders_dim", 0.1)]
    return schema.best(_rows(spark, rows, "schema_id string, clusters int, largest_cluster int, largest_separator int"))


# ---- decompositions --------------------------------------------------------------------------------------------------


def _list(mask: int) -> str:
    return ", ".join(f"a{i}" for i in bits.members(mask))


def sql_natural_join(clusters: list[int]) -> str:
    """The natural join of distinct projections, NULL equal to NULL; clusters in an order in which they hang together."""
    left, seen, out = clusters[1:], clusters[0], f"(SELECT DISTINCT {_list(clusters[0])} FROM r)"
    while left:
        c = next(c for c in left if c & seen)
        left.remove(c)
        on = " AND ".join(f"p.a{i} IS NOT DISTINCT FROM q.a{i}" for i in bits.members(c & seen))
        new = ", ".join(["p.*", *(f"q.a{i}" for i in bits.members(c & ~seen))])
        out, seen = f"(SELECT {new} FROM {out} p JOIN (SELECT DISTINCT {_list(c)} FROM r) q ON {on})", seen | c
    return out


for _name, (_fx, _clusters) in DECOMPOSITIONS.items():
    _sizes = " UNION ALL ".join(f"SELECT {c}::BIGINT AS cluster, count(*)::BIGINT AS tuples FROM (SELECT DISTINCT {_list(c)} FROM r)" for c in _clusters)

    @add(f"projection_sizes_{_name}", f"WITH {sql_relation(_fx)} {_sizes}")
    def _(spark, sf, fx=_fx, cs=_clusters):
        return decompose.projection_sizes(relation(spark, sf, fx), cs)

    if _name == "line_cyclic":
        # attribute 3 joins the last two; the first three make a cycle of their own
        _joined = f"SELECT (SELECT count(*) FROM {sql_natural_join(_clusters[:3])}) * (SELECT count(*) FROM {sql_natural_join(_clusters[3:])}) AS j"
    else:
        _joined = f"SELECT count(*) AS j FROM {sql_natural_join(_clusters)}"

    @add(f"spurious_tuples_{_name}", f"WITH {sql_relation(_fx)}, j AS ({_joined}), d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM r)) SELECT j::BIGINT AS joined, (j - d)::BIGINT AS spurious FROM j, d")
    def _(spark, sf, fx=_fx, cs=_clusters):
        r = relation(spark, sf, fx)
        n = decompose.join_size(r, cs)
        return _rows(spark, [(n, n - r.distinct_rows)], "joined bigint, spurious bigint")

    @add(f"decomposition_metrics_{_name}", f"WITH {sql_relation(_fx)}, s AS ({_sizes}), j AS ({_joined}), d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM r)) SELECT min(tuples)::BIGINT AS smallest, max(tuples)::BIGINT AS largest, sum(tuples)::BIGINT AS tuples, sum(tuples * bit_count(cluster))::BIGINT AS cells, max(j)::BIGINT AS joined, (max(j) - max(d))::BIGINT AS spurious FROM s, j, d")
    def _(spark, sf, fx=_fx, cs=_clusters):
        d = decompose.evaluate(relation(spark, sf, fx), cs)
        return _rows(spark, [(d.smallest, d.largest, d.tuples, d.cells, d.joined, d.spurious)], "smallest bigint, largest bigint, tuples bigint, cells bigint, joined bigint, spurious bigint")


_LOSSY = DECOMPOSITIONS["orders_lossy"][1]


@add("natural_join_orders_lossy", f"WITH {sql_relation('orders_dim')} SELECT a0 AS status, a1 AS priority, a2::INT AS y, a3::INT AS m, a4::INT AS qt FROM {sql_natural_join(_LOSSY)}")
def _(spark, sf):
    got = decompose.natural_join(relation(spark, sf, "orders_dim"), _LOSSY)
    return got.select(F.col("a0").alias("status"), F.col("a1").alias("priority"), F.col("a2").alias("y"), F.col("a3").alias("m"), F.col("a4").alias("qt"))


@add("cross_join_decomposition", f"WITH {sql_relation('orders_dim')} SELECT ((SELECT count(DISTINCT a0) FROM r) * (SELECT count(DISTINCT a1) FROM r) * (SELECT count(*) FROM (SELECT DISTINCT a2, a3 FROM r)))::BIGINT AS joined")
def _(spark, sf):
    return _rows(spark, [(decompose.join_size(relation(spark, sf, "orders_dim"), [1, 2, 12]),)], "joined bigint")


@add("distinct_projection_orders_dim", f"WITH {sql_relation('orders_dim')} SELECT DISTINCT a3::INT AS m, a4::INT AS qt, 1::BIGINT AS cnt FROM r")
def _(spark, sf):
    return relation(spark, sf, "orders_dim").project(0b11000).select(F.col("a3").alias("m"), F.col("a4").alias("qt"), F.lit(1).cast("bigint").alias("cnt"))


# ---- sets and files --------------------------------------------------------------------------------------------------

_SETS = """SELECT m.range AS m, bit_count(m.range)::INT AS size, (m.range | 8)::BIGINT AS added, (m.range & ~4)::BIGINT AS removed, xor(m.range, 2)::BIGINT AS flipped, (31 - m.range)::BIGINT AS complement,
(m.range & 19)::BIGINT AS both_19, (m.range | 19)::BIGINT AS union_19, (m.range & ~19)::BIGINT AS minus_19, (m.range & 19) <> 0 AS meets_19, (m.range & 19) = 19 AS covers_19, ((m.range >> 4) & 1) = 1 AS has_4,
'{' || array_to_string(list_transform(list_filter(range(0, 5), lambda i: ((m.range >> i) & 1) = 1), lambda i: i::VARCHAR), ', ') || '}' AS shown,
array_to_string(list_transform(range(0, 5), lambda i: ((m.range >> i) & 1)::VARCHAR), '') AS digits FROM range(0, 32) m"""


@add("attribute_set_functions", _SETS)
def _(spark, sf):
    m = F.col("m")
    return spark.range(32).select(F.col("id").alias("m")).select(
        "m", bits.c_size(m).cast("int").alias("size"), bits.c_add(m, 3).alias("added"), bits.c_remove(m, 2).alias("removed"), bits.c_flip(m, 1).alias("flipped"), bits.c_complement(m, 5).alias("complement"),
        bits.c_both(m, 19).alias("both_19"), bits.c_union(m, 19).alias("union_19"), bits.c_minus(m, 19).alias("minus_19"), bits.c_meets(m, 19).alias("meets_19"), bits.c_covers(m, F.lit(19)).alias("covers_19"), bits.c_has(m, 4).alias("has_4"),
        bits.c_text(m, 5).alias("shown"), bits.c_bit_string(m, 5).alias("digits"),
    )


_SEPS = ["13,{{4, 9}|{1},{6, 11},{2, 5, 7, 8, 10, 12},{3}},8.88E-16", "5,{{}|{0, 1},{2, 3, 4}},0.25", "not a dependency"]


@add("sep_codec", "SELECT * FROM (VALUES (13, 528::BIGINT, '2|8|2112|5540', 8.88e-16::DOUBLE), (5, 0::BIGINT, '3|28', 0.25::DOUBLE)) t(arity, lhs, components, measure)")
def _(spark, sf):
    got = sepfile.parse_columns(_rows(spark, [(x,) for x in _SEPS], "value string"))
    return got.select("arity", "lhs", _text().alias("components"), "measure")


def _written(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that driver and executors share; on one machine, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="trellis-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/trellis-queries/{label}-{uuid.uuid4().hex}"


@add("lhs_statistics", f"WITH {sql_entropies('orders_dim')}, {sql_full_mvds('orders_dim', 0.1)} SELECT count(*)::BIGINT AS jds, min(bit_count(lhs))::BIGINT AS min_lhs, max(bit_count(lhs))::BIGINT AS max_lhs, round(avg(bit_count(lhs)), 6) + 0.0 AS avg_lhs FROM fm")
def _(spark, sf):
    return sepfile.lhs_statistics(mining.jd_rows(spark, _mined(spark, sf, "orders_dim", 0.1)))


@add("sep_files_orders_dim", f"WITH {sql_entropies('orders_dim')}, {sql_full_mvds('orders_dim', 0.1)} SELECT 5 AS arity, lhs, {_TEXT.format('cs')} AS components, round(j, 6) + 0.0 AS measure FROM fm")
def _(spark, sf):
    """Mined dependencies written to a file and read back."""
    path = _written(spark, "sep")
    sepfile.write_sep(spark, path, arity("orders_dim"), _mined(spark, sf, "orders_dim", 0.1))
    return sepfile.read_sep(spark, path).select("arity", "lhs", _text().alias("components"), measures.rounded(F.col("measure")).alias("measure"))


def _as_csv(spark: SparkSession, sf: str, fx: str) -> str:
    """The relation as comma-separated files with blanks around the cells; quoted, with a header."""
    path, r = _written(spark, "csv"), relation(spark, sf, fx)
    cells = [F.concat(F.lit("  "), F.col(f"a{i}").cast("string"), F.lit(" ")).alias(c) for i, c in enumerate(r.names)]
    options = {"header": True, "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    r.df.select(*cells).write.options(**options).csv(path)
    return path


@add("csv_rows_cust_geo", f"WITH {sql_relation('cust_geo')} SELECT " + ", ".join(f"a{i}::VARCHAR AS a{i}" for i in range(5)) + " FROM r")
def _(spark, sf):
    return read_csv(spark, _as_csv(spark, sf, "cust_geo"), header=True).df


@add("csv_entropies_orders_dim", f"WITH {sql_entropies('orders_dim')} SELECT m AS mask, round(h, 6) + 0.0 AS h FROM e")
def _(spark, sf):
    return entropy.cube(read_csv(spark, _as_csv(spark, sf, "orders_dim"), header=True)).select("mask", measures.rounded(F.col("h")).alias("h"))


@add("mining_metrics_orders_dim", f"WITH {sql_entropies('orders_dim')}, {sql_full_mvds('orders_dim', 0.1)} SELECT 5 AS attributes, (SELECT count(*) FROM r)::BIGINT AS n_rows, TRUE AS complete, (SELECT count(DISTINCT s) FROM minsep)::BIGINT AS separators, (SELECT count(*) FROM fm)::BIGINT AS full_mvds")
def _(spark, sf):
    """The metrics of a run as they were written to and read from their CSV sink."""
    path = _written(spark, "metrics")
    mining.write_metrics(spark, [mining.mine(relation(spark, sf, "orders_dim"), 0.1).metrics], path)
    got = spark.read.option("header", True).csv(path)
    return got.select(F.col("attributes").cast("int"), F.col("rows").cast("bigint").alias("n_rows"), F.col("completed_full_mvds").cast("boolean").alias("complete"), F.col("separators").cast("bigint"), F.col("full_mvds").cast("bigint"))


for _fx, _eps in (("cust_geo", 0.0), ("orders_dim", 0.1)):
    _n = arity(_fx)

    @add(f"verify_separators_{_fx}", f"WITH {sql_entropies(_fx)}, {sql_mvds(_fx)}, {sql_separators(_n, _eps)} SELECT count(*)::BIGINT AS separators, 0::BIGINT AS differences, 0::BIGINT AS failures FROM minsep")
    def _(spark, sf, fx=_fx, eps=_eps):
        """Mined separators held against those that all MVDs imply, and each one checked by itself."""
        r = relation(spark, sf, fx)
        found = mining.mine(r, eps, with_full_mvds=False).separators
        return _rows(spark, [(sum(map(len, found.values())), len(mining.verify(r, eps)), len(mining.self_check(r, eps)))], "separators bigint, differences bigint, failures bigint")


_JOBS = DECOMPOSITIONS["orders_lossy"][1]


@add("decomposition_jobs_orders_dim", f"WITH {sql_relation('orders_dim')}, j AS (SELECT count(*) AS j FROM {sql_natural_join(_JOBS)}) SELECT * FROM (VALUES ('first'), ('asked again')) t(job), (SELECT j::BIGINT AS joined, TRUE AS same FROM j)")
def _(spark, sf):
    """A job and the same clusters asked for again, which gives the same job."""
    jobs = decompose.DecompositionJobs(relation(spark, sf, "orders_dim"))
    try:
        one = jobs.submit(_JOBS)
        two = jobs.submit(reversed(_JOBS))
        rows = [(name, job.future.result().joined, one is two) for name, job in (("first", one), ("asked again", two))]
    finally:
        jobs.stop()
    return _rows(spark, rows, "job string, joined bigint, same boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mine supp_geo exactly, take the schema with most clusters and judge its decomposition."""
    r = relation(spark, sf_dir, "supp_geo")
    found = list(schema.acyclic_schemas(r.n, mining.mine(r, 0.0).full_mvds))
    top = max(found, key=lambda s: (len(s.clusters), -s.largest_cluster, s.clusters))
    d = decompose.evaluate(r, top.clusters)
    return _rows(spark, [(" ".join(bits.text(c) for c in d.clusters), d.smallest, d.largest, d.tuples, d.cells, d.joined, d.spurious)], "clusters string, smallest bigint, largest bigint, tuples bigint, cells bigint, joined bigint, spurious bigint")


add("flagship_supp_geo", f"""WITH {sql_schemas("supp_geo", 0.0)}, b AS MATERIALIZED (
SELECT t, count(*) AS k, list_sort(list(m)) AS ms FROM top GROUP BY t QUALIFY row_number() OVER (ORDER BY count(*) DESC, max(bit_count(m)), list_sort(list(m)) DESC) = 1)
SELECT string_agg('{{' || array_to_string(list_transform(list_filter(range(0, 5), lambda i: ((m >> i) & 1) = 1), lambda i: i::VARCHAR), ', ') || '}}', ' ' ORDER BY m) AS clusters,
min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest, sum(n)::BIGINT AS tuples, sum(n * bit_count(m))::BIGINT AS cells,
(SELECT count(*) FROM (SELECT DISTINCT * FROM r))::BIGINT AS joined, 0::BIGINT AS spurious FROM b JOIN top USING (t) JOIN gs USING (m)""")(flagship)  # epsilon 0: the join is the relation
