"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, slices

#: Characters of the sampled documents of one label at most.
FIT_CHARS = 32_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], chars: int = FIT_CHARS) -> Table:
    """(doc_id, text, label): up to rows[v] documents of each label v, and up to ``chars`` characters of each, chosen by a hash
    of doc_id; of documents that share the least shingle (most copies do) and the label, that with the smallest doc_id stays.
    Texts are taken whole or not at all: one that would go beyond ``chars`` is left out. The same tables give the same
    sample. labels holds the rows that may be learned from.

    The ids are the only thing broadcast: at most sum(rows.values()) pairs. A document with several labels has the
    largest, one that comes more than once has the text that sorts first; null ids and labels, and labels without document,
    are left out."""
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value, n in rows.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = plain.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    files = 1 + sum(rows.values()) // 1000
    chosen = Table(chosen, "chosen", files)
    sizes = chosen.df.select("doc_id", "label", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # of picked
    held, out = dict.fromkeys(rows, 0), []
    for doc, value, n in sizes:
        if held[value] + n <= chars:
            held[value] += n
        else:
            out.append(doc)
    within = chosen.df.where(~F.col("doc_id").isin(out)) if out else chosen.df

    def least(batches):
        import pyarrow as pa

        from .shingles import shingle_sets

        for batch in batches:
            for part in slices(batch, "text"):
                first = [int(s[0]) - (1 << 63) if len(s) else 0 for s in shingle_sets(part.column("text"))]
                yield pa.record_batch([*part.columns, pa.array(first, pa.int64())], names=[*part.schema.names, "least"])

    marked = within.select("doc_id", "text", "label").mapInArrow(least, "doc_id long, text string, label int, least long")
    one = marked.groupBy("label", "least").agg(F.min(F.struct("doc_id", "text")).alias("one"))
    done = Table(one.select("one.doc_id", "one.text", "label"), "sample", files)
    chosen.drop()
    return done
