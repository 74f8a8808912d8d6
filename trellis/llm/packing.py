"""Best-fit packing with certified bin counts."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table
from .tokens import encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a window that is packed by itself at first, where the pieces have an order.
WINDOW = 1024


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, order: Sequence[str] = ()) -> DataFrame:
    """One row per piece: documents longer than capacity are cut every capacity ids. No shuffle. Columns of ``order``,
    whole numbers, come along as _order0, _order1 and so on."""
    places = [f"_order{i}" for i in range(len(order))]

    def pieces(batches):
        import pyarrow as pa

        for part, texts in encoded(batches, tokenizer, end_id):
            out = [[], [], [], [], []]
            rows = []
            for row, (doc, ids) in enumerate(zip(part.column("doc_id").to_pylist(), texts, strict=True)):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[at : at + 4 * capacity]
                    for column, v in zip(out, (doc, k, at // 4, len(x) // 4, zlib.crc32(x)), strict=True):
                        column.append(v)
                    rows.append(row)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            along = [part.column(c).take(pa.array(rows, pa.int64())) for c in places]
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(out, types, strict=True)), *along], names=["doc_id", "piece", "start", "length", "ids_crc32", *places])

    along = [F.col(f"`{c}`").cast("long").alias(p) for c, p in zip(order, places, strict=True)]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *along)
    return plain.mapInArrow(pieces, ", ".join([PIECES, *(f"{p} long" for p in places)]))


def lower_bound(lengths, capacity: int) -> int:
    """The most bins that any of these dual feasible functions proves necessary, in integers: the identity; for each
    threshold e up to capacity/2 the one that rounds x > capacity-e up to capacity and x < e down to 0; and for k = 1..20
    the one that maps x to floor((k+1)x/capacity)/k, or to x itself where (k+1)x is a multiple of capacity."""
    import numpy as np

    if not len(lengths):
        return 0
    count = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    mass, n = np.concatenate([[0], np.cumsum(count * x)]), np.concatenate([[0], np.cumsum(count)])
    e = np.arange(1, capacity // 2 + 1)
    inner = mass[capacity - e + 1] - mass[e]
    total = inner + (n[-1] - n[capacity - e + 1]) * capacity
    best = max(best, int((-(-total // capacity)).max()) if len(e) else 0)
    for k in range(1, 21):
        y = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * y).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity: int):
    """(bin, offset) of each length: longest first, each into the fullest bin that still takes it."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins, offsets


def _packer(r: int, capacity: int, ordered: bool = False):
    """Packs one partition's rows in round r; the rows gain sequence_id, offset, certified and _final. With ``ordered`` a
    sequence has the _uid of its longest piece."""

    def one(pdf):
        import numpy as np

        part = int(pdf["_part"].iloc[0])
        pdf = pdf.drop(columns="_part").sort_values("_uid", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        b, at = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(b, weights=lengths).astype(np.int64)
        met = len(fill) == lower_bound(lengths, capacity)
        final = fill == capacity
        if met:
            final[:] = True
            final[int(np.argmin(fill))] = fill.min() == capacity
        ids = (r << 56) + (part << 28) + b
        if ordered:
            first = np.empty(len(fill), np.int64)
            first[b[at == 0]] = pdf["_uid"].to_numpy()[at == 0]
            ids = first[b]
        return pdf.assign(sequence_id=ids, offset=at, certified=met, _final=final[b])

    return one


def pack(pieces: DataFrame, capacity: int = 4096, part_rows: int = 8192, rounds: int = 6, order: Sequence[str] = ()) -> DataFrame:
    """Add sequence_id, offset and certified to rows with a ``length`` from 1 to capacity; all other columns stay.

    Bound-certified repacking. Rows of full length are sequences by themselves. The others are dealt evenly to partitions
    of about part_rows rows; each packs its own by best-fit decreasing and holds the count against lower_bound(). Bins
    without room are final. A partition that meets its bound is certified: its other bins are final as well, but for the
    emptiest. What is not final is exchanged: dealt anew among fewer partitions, and packed again. This ends when one
    partition holds the rest, a round no longer saves a bin (then the packing before it stands), or after ``rounds``.
    A task never holds more than about part_rows rows whatever the size or skew of the input.

    With ``order`` the rows are first numbered by these columns. Partitions are then windows of consecutive rows, of about
    WINDOW at first and twice as many each time that what is left is packed again, up to part_rows, and sequence_id rises as the longest pieces of the
    sequences do in that order: a prefix of the sequences holds the rows of a prefix of the order, but for about one window
    and for less than one sequence of each window that is certified.

    Columns of these names (and _uid, _part, _final) are replaced. Empty input: empty result. Repeated rows are rows of their own. Rows with a null or out-of-range length are refused."""
    spark = pieces.sparkSession
    own = ("sequence_id", "offset", "certified", "_uid", "_part", "_final")
    columns = [c for c in pieces.columns if c not in own]
    pieces = pieces.select(*(F.col(f"`{c}`") for c in columns))
    columns = [f"`{c}`" for c in columns]
    ok = F.col("length").between(1, capacity)
    checked = pieces.withColumn("length", F.when(ok, F.col("length")).otherwise(F.raise_error(F.lit(f"length must be 1 to {capacity}"))).cast("long"))
    if order:  # written first: dealing by ranges reads its input twice
        k = max(1, -(-pieces.count() // 500_000))
        checked = checked.repartitionByRange(k, *(F.col(f"`{c}`") for c in order)).sortWithinPartitions(*(F.col(f"`{c}`") for c in order))
    base = Table(checked.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    full = base.df.where(F.col("length") == capacity).select(*columns, (F.col("_uid") + F.lit(0 if order else 1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    parts, todo = [full], base.df.where(F.col("length") < capacity)
    n, before, kept = todo.count(), None, None
    schema = todo.schema
    for r in range(rounds):
        if not n:
            break
        k = max(1, -(-n // (min(WINDOW << r, part_rows) if order else part_rows)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

        if order:
            dealt = todo.repartitionByRange(k, "_uid").withColumn("_part", F.spark_partition_id().cast("long"))
        else:
            dealt = todo.withColumn("_part", F.pmod(F.xxhash64("_uid", F.lit(r)), F.lit(k)).cast("long"))
        done = Table(dealt.groupBy("_part").applyInPandas(_packer(r, capacity, bool(order)), f"{fields}, sequence_id long, offset long, certified boolean, _final boolean"), f"packed{r}")
        rest = done.df.where(~F.col("_final"))
        opens = F.when(F.col("offset") == 0, 1)  # one row of each bin
        all_bins, bins, left = done.df.agg(F.count(opens), F.count(F.when(~F.col("_final"), opens)), F.count(F.when(~F.col("_final"), 1))).first()
        if before is not None and all_bins >= before:
            parts.append(kept)
            n = 0
            break
        parts.append(done.df.where("_final"))
        kept, before, n = rest, bins, left
        todo = rest.drop("sequence_id", "offset", "certified", "_final")
        if k == 1:
            break
    if n and kept is not None:
        parts.append(kept)
    out = [p.select(*columns, "sequence_id", "offset", "certified") for p in parts]
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, order: Sequence[str] = ()) -> DataFrame:
    """Encode (null text: only the end id), cut and pack whole documents: PIECES with sequence_id, offset, certified. With
    ``order``, columns of whole numbers, sequences follow it as pack() says."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, order)
    if not order:
        return pack(pieces, capacity)
    places = [f"_order{i}" for i in range(len(order))]
    return pack(Table(pieces, "cut").df, capacity, order=[*places, "doc_id", "piece"]).drop(*places)
