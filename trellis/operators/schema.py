"""Acyclic schemas: maximal sets of compatible join dependencies, and their join trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from .combinatorics import Graph
from .measures import JD


def compatible(a: JD, b: JD, allow_nested: bool = False) -> bool:
    """Neither left side contains the other (with allow_nested, an inclusion is fine), each lies with one component of the
    other, and each side with that component meets two components or more of the other."""
    s, t = a.lhs, b.lhs
    if s == t:
        return False
    if not allow_nested and (s & t == s or s & t == t):
        return False
    ca = [c for c in a.components if (s | c) & t == t]
    cb = [d for d in b.components if (t | d) & s == s]
    if allow_nested and (s & t in (s, t)):
        return bool(ca) if s & t == s else bool(cb)
    return any(sum(bool(d & (s | c)) for d in b.components) >= 2 for c in ca) and any(sum(bool(c & (t | d)) for c in a.components) >= 2 for d in cb)


def c_compatible(s: Column, cs: Column, t: Column, ds: Column) -> Column:
    """compatible() over columns: left sides BIGINT, components ARRAY<BIGINT>."""

    def side(s, cs, t, ds):
        def fits(c):
            reach = bits.c_union(s, c)
            return bits.c_covers(reach, t) & (F.size(F.filter(ds, lambda d: bits.c_meets(d, reach))) >= 2)

        return F.exists(cs, fits)

    apart = ~bits.c_covers(s, t) & ~bits.c_covers(t, s)
    return apart & side(s, cs, t, ds) & side(t, ds, s, cs)


def conflicts(jds: DataFrame) -> DataFrame:
    """(a, b) of the JDs (id, lhs, components) that don't go together, a < b; ids are 0, 1, 2, ... Each JD asks for those
    after it by id, an equi-join."""
    last = jds.count() - 1
    a = jds.select(F.col("id").alias("a"), F.col("lhs").alias("s"), F.col("components").alias("cs")).where(F.col("a") < last)
    b = jds.select(F.col("id").alias("b"), F.col("lhs").alias("t"), F.col("components").alias("ds"))
    both = a.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.lit(last)))).join(b, "b")
    return both.where(~c_compatible(F.col("s"), F.col("cs"), F.col("t"), F.col("ds"))).select("a", "b")


def conflict_graph(jds: Sequence[JD], allow_nested: bool = False) -> Graph:
    return Graph(len(jds), [(i, j) for i in range(len(jds)) for j in range(i + 1, len(jds)) if not compatible(jds[i], jds[j], allow_nested)])


@dataclass
class Node:
    members: int
    kind: str  # cluster or separator
    level: int
    parent: int | None
    children: list[int] = field(default_factory=list)


@dataclass
class AcyclicSchema:
    n: int
    jds: list[JD]

    def __post_init__(self):
        self.jds = sorted(self.jds, key=lambda d: (d.lhs.bit_count(), d.lhs, d.components))

    def add(self, jd: JD, allow_nested: bool = False) -> bool:
        """Add a JD that goes with all others."""
        if all(compatible(jd, d, allow_nested) for d in self.jds):
            self.jds.append(jd)
            self.__post_init__()
            return True
        return False

    def tree(self) -> list[Node]:
        """Nodes breadth first, from all attributes down: the first JD not used yet (small left sides first) whose left
        side lies in a node and that leaves two parts or more of it makes it a separator over these parts."""
        nodes = [Node(bits.full(self.n), "cluster", 0, None)]
        unused, at = list(self.jds), 0
        while at < len(nodes):
            node = nodes[at]
            for d in unused:
                if d.lhs & node.members != d.lhs:
                    continue
                parts = [p for c in d.components if (p := (c | d.lhs) & node.members) != d.lhs]
                unused.remove(d)
                if len(parts) < 2:
                    break
                for p in parts:
                    node.children.append(len(nodes))
                    nodes.append(Node(p, "cluster", node.level + 1, at))
                node.kind, node.members = "separator", d.lhs
                break
            else:
                at += 1
                continue
            if node.kind == "separator":
                at += 1
        return nodes

    @property
    def clusters(self) -> list[int]:
        return sorted({x.members for x in self.tree() if x.kind == "cluster"})

    @property
    def separators(self) -> list[int]:
        return sorted({x.members for x in self.tree() if x.kind == "separator"})

    @property
    def measure(self) -> float:
        """The sum of the JDs' measures: an estimate."""
        return sum(d.measure for d in self.jds)

    @property
    def largest_cluster(self) -> int:
        return max(c.bit_count() for c in self.clusters)

    @property
    def largest_separator(self) -> int:
        return max((s.bit_count() for s in self.separators), default=0)

    def __str__(self) -> str:
        return "\n".join(f"{x.kind}, level: {x.level}: {bits.text(x.members)}" for x in self.tree())


def acyclic_schemas(n: int, jds: Sequence[JD], allow_nested: bool = False) -> Iterator[AcyclicSchema]:
    """One for each maximal set of JDs that go together, each once; JDs in canonical order, so the order is fixed."""
    jds = sorted(set(jds))
    for chosen in conflict_graph(jds, allow_nested).maximal_independent_sets():
        yield AcyclicSchema(n, [jds[i] for i in bits.members(chosen)])


def best(schemas: DataFrame) -> DataFrame:
    """The schemas (schema_id, clusters, largest_cluster, largest_separator) that are best by one criterion, ties included:
    most clusters, smallest largest cluster, smallest largest separator."""
    top = schemas.agg(F.max("clusters"), F.min("largest_cluster"), F.min("largest_separator")).first()
    each = [("most clusters", "clusters", top[0]), ("smallest largest cluster", "largest_cluster", top[1]), ("smallest largest separator", "largest_separator", top[2])]
    named = F.array(*(F.when(F.col(c) == v, F.lit(name)) for name, c, v in each))
    return schemas.select(F.explode(named).alias("criterion"), "schema_id").where("criterion is not null")
