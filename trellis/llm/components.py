"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table


#: Links in a file, of this module's tables.
LINKS_PER_FILE = 500_000


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs. Returns (node, root) for every node with a link to another; root names the component.

    Each round every node points to its smallest neighbour or itself, pointers are doubled, and the links are drawn anew
    between what their ends point to; loops and repeats go. A component halves at least each round, whatever its shape.
    Each step is a grouped minimum with partial aggregation or a join of two written tables, whose hot keys Spark splits;
    nothing is collected. Nulls and loops are no links; an empty table gives an empty result."""
    files = 1 + links.count() // LINKS_PER_FILE
    clean = links.where(F.col("a") != F.col("b"))
    both = clean.select(F.col("a").alias("u"), F.col("b").alias("v")).union(clean.select("b", "a")).distinct()
    edges = Table(both, "edges", files)
    labels: Table | None = None
    while not edges.df.isEmpty():
        near = Table(edges.df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "near", files)
        far = near.df.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = Table(near.df.join(far, "p").select("u", F.col("q").alias("p")), "jumped", files)
        ends = jumped.df.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        drawn = edges.df.join(jumped.df, "u").join(ends, "v").select(F.col("p").alias("u"), F.col("pv").alias("v"))
        left = Table(drawn.where("u != v").distinct(), "edges", files)
        if labels is None:
            labels = Table(jumped.df.select(F.col("u").alias("node"), F.col("p").alias("root")), "labels", files)
        else:
            step = jumped.df.select(F.col("u").alias("root"), "p")
            new = Table(labels.df.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels", files)
            labels.drop()
            labels = new
        for t in (near, jumped, edges):
            t.drop()
        edges = left
    edges.drop()
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return labels.df
