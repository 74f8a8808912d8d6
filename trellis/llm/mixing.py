"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table

#: Rows that one window of a source holds on average at most, however large the source; how many times that are too many.
BUCKET_ROWS, HOT_BUCKET = 1000, 20
#: The schedule is broadcast up to so many slots (8 bytes each).
MAX_BROADCAST_SLOTS = 1 << 20
#: Blocks of a source that one row of the schedule holds.
GROUP = 64


class Fluid:
    """The ideal schedule: at every moment all sources that still have blocks are served at once, in proportion to their units.
    When a source has been served whole, the others share what it had. With v the service of a source of one unit, a source
    of u units and n blocks has had min(n, u v), and time is the sum of these over all sources."""

    def __init__(self, units: Mapping, blocks: Mapping):
        self.units, self.blocks = units, {s: n for s, n in blocks.items() if n > 0}
        ending = sorted(self.blocks, key=lambda s: self.blocks[s] / units[s])
        # from v = ends[k] on, until the next: blocks of the sources that have ended, units of those that haven't
        self.ends, self.done, self.rate = [0.0], [0], [sum(units[s] for s in ending)]
        for s in ending:
            self.ends.append(self.blocks[s] / units[s])
            self.done.append(self.done[-1] + self.blocks[s])
            self.rate.append(self.rate[-1] - units[s])

    def window(self, source, block: int) -> tuple[int, int]:
        """(release, deadline) of a block: the slots in which the ideal schedule begins and ends to serve it, in whole
        numbers throughout, so that nothing is rounded."""
        u = self.units[source]
        k = bisect.bisect_right(self.ends, block / u) - 1
        release = self.done[k] + block * self.rate[k] // u
        k = bisect.bisect_left(self.ends, (block + 1) / u) - 1
        return release, self.done[k] - -(block + 1) * self.rate[k] // u


def schedule(units: Mapping, blocks: Mapping) -> dict:
    """The slot of every block of every source: Pfair scheduling of unit blocks. A slot goes to the block with the earliest
    deadline (ties by the order of sources) among those released and next in their source. The ideal schedule serves every
    block between its release and its deadline at a total rate of one, so no deadline is missed, and after every slot each
    source has had its ideal service to less than one block, from the first slot to the last. The work grows as the blocks
    do, times the logarithm of the number of sources."""
    ideal = Fluid(units, blocks)
    names = sorted(ideal.blocks, key=lambda s: (s is not None, s))
    out: dict = {s: [] for s in blocks}
    waiting, ready = [], []
    for i, s in enumerate(names):
        release, deadline = ideal.window(s, 0)
        waiting.append((release, i, deadline))
    heapq.heapify(waiting)
    for slot in range(sum(ideal.blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, i, deadline = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i))
        _, i = heapq.heappop(ready)
        s = names[i]
        out[s].append(slot)
        if len(out[s]) < ideal.blocks[s]:
            release, deadline = ideal.window(s, len(out[s]))
            heapq.heappush(waiting, (release, i, deadline))
    return out


def grouped(slots: Mapping) -> Iterator[tuple]:
    """(source, group, slots of the blocks from GROUP * group on), GROUP blocks in a row at most."""
    for s, mine in slots.items():
        for at in range(0, len(mine), GROUP):
            yield s, at // GROUP, mine[at : at + GROUP]


def target_units(totals: Mapping, weights: Mapping | None, resolution: int = 1024) -> dict:
    """Whole units, one at least, in proportion to the weights; without weights, to the square roots of the totals.
    A source that ``weights`` doesn't name, or gives no positive weight, has one unit. There are as many units as
    characters at least, and more of them with many sources: over the whole schedule, rounding moves no source by a
    hundredth of a block (of 32,768 characters) from its target."""
    least = max(resolution, sum(totals.values()) * max(1, len(totals) // 64))
    resolution = 1 << (least - 1).bit_length()
    raw = {s: (max(0.0, float(weights.get(s, 0) or 0)) if weights else max(1, t) ** 0.5) for s, t in totals.items()}
    whole = sum(raw.values()) or 1.0
    return {s: max(1, round(resolution * r / whole)) for s, r in raw.items()}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = 32768, seed: int = 3) -> DataFrame:
    """All rows and columns of docs with mix_block, mix_place and mix_slot: read in order of (mix_slot, mix_place), any
    prefix holds the sources in proportion to their weights to less than one block each (those that still have documents:
    when one has given all, the others share its part in proportion). Nothing is dropped or repeated.

    Documents of a source are shuffled by a hash of doc_id and text and laid end to end; block b holds those that begin in its
    b-th ``block_chars`` characters (an empty or null text counts as one). Every block gets a slot by Pfair scheduling:
    release times and deadlines follow from the target weight, and the earliest deadline goes first. The driver makes the
    schedule, a number for each block (about a million for 30 GB); rows find theirs by source and block.

    Places in a source come from windows over hash buckets of about BUCKET_ROWS rows, with the sums of the buckets before;
    so a source of any size is never in one task. Rows equal in doc_id and text share a bucket; where so many are equal that
    a bucket would hold more than HOT_BUCKET times BUCKET_ROWS, docs are written once with a number for each row, which goes
    into the hash. Only one row a source reaches the driver, and only a number a block leaves it. A null source is a source.
    Ties (rows equal in doc_id, text and size) fall in any order; repeated rows stay. mix_* columns of docs are replaced.
    An empty table gives an empty one."""
    import pyarrow as pa

    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("mix_block", "mix_place", "mix_slot")]
    pad = "_" * (1 + max((len(c) for c in keep), default=0))  # our own columns' names are longer than any of docs
    source, size, h, bucket, inside, place, block, doc, row = (pad + x for x in ("source", "size", "h", "bucket", "inside", "place", "block", "doc", "row"))
    length = F.coalesce(F.greatest(F.lit(1), F.length("text")), F.lit(1)).cast("long")
    buckets = max(1, min(1 << 20, -(-docs.select(F.lit(1)).count() // BUCKET_ROWS)))

    def hashed(rows: DataFrame, number) -> tuple[DataFrame, DataFrame]:
        """Rows with our own columns, and what their buckets hold."""
        key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text").cast("string"), number)
        rows = rows.select(*(F.col(f"`{c}`") for c in keep), F.col("source").cast("string").alias(source), F.col("doc_id").cast("long").alias(doc), length.alias(size), key.alias(h))
        rows = rows.withColumn(bucket, F.floor(F.shiftrightunsigned(h, 44) * buckets / (1 << 20)).cast("int"))
        held = rows.groupBy(F.col(source).alias("source"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))
        return rows, Table(held, "sums", 1 + 20 * buckets // 500_000).df

    rows, sums = hashed(docs, F.lit(0))
    if (sums.agg(F.max("n")).first()[0] or 0) > HOT_BUCKET * BUCKET_ROWS:
        rows, sums = hashed(Table(docs.withColumn(row, F.monotonically_increasing_id()), "rows").df, F.col(row))
    totals = {r["source"]: r["size"] for r in sums.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # a row a source
    if not totals:
        zero = F.lit(0).cast("long")
        return docs.select(*(F.col(f"`{c}`") for c in keep), zero.alias("mix_block"), zero.alias("mix_place"), zero.alias("mix_slot"))
    blocks = {s: -(-t // block_chars) for s, t in totals.items()}
    slots = list(grouped(schedule(target_units(totals, weights), blocks)))
    kinds = {f"{pad}other": pa.string(), f"{pad}group": pa.int64(), f"{pad}slots": pa.list_(pa.int64())}
    # an Arrow table goes to the JVM as it is; rows would take Python workers, and a second daemon, on the executors
    table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*slots, strict=True), kinds.values(), strict=True)], names=list(kinds)))
    if sum(blocks.values()) <= MAX_BROADCAST_SLOTS:
        table = F.broadcast(table)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias(f"{pad}s"), F.col("bucket").alias(f"{pad}b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias(f"{pad}start"))
    if len(totals) * buckets <= MAX_BROADCAST_SLOTS:
        starts = F.broadcast(starts)
    run = Window.partitionBy(source, bucket).orderBy(h, doc, size).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(inside, F.coalesce(F.sum(size).over(run), F.lit(0)))
    placed = placed.join(starts, F.col(source).eqNullSafe(F.col(f"{pad}s")) & (F.col(bucket) == F.col(f"{pad}b")))
    placed = placed.withColumn(place, F.col(f"{pad}start") + F.col(inside)).withColumn(block, F.floor(F.col(place) / block_chars).cast("long"))
    group, within = F.floor(F.col(block) / GROUP).cast("long"), (F.col(block) % GROUP).cast("int")
    found = placed.join(table, F.col(source).eqNullSafe(F.col(f"{pad}other")) & (group == F.col(f"{pad}group")))
    slot = F.get(F.col(f"{pad}slots"), within)
    return found.select(*(F.col(f"`{c}`") for c in keep), F.col(block).alias("mix_block"), F.col(place).alias("mix_place"), slot.cast("long").alias("mix_slot"))


def in_order(docs: DataFrame, places: bool = False, **options) -> DataFrame:
    """The rows of docs in the order of mix(), dealt by ranges of it, with docs' own columns; with ``places`` also
    mix_slot and mix_place, by which a reader of the written rows finds the order again."""
    mixed = mix(docs, **options)
    columns = [f"`{c}`" for c in docs.columns if not places or c not in ("mix_slot", "mix_place")]
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*columns, *(("mix_slot", "mix_place") if places else ()))
