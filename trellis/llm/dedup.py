"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import math
import secrets

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Table, release, slices

#: Fewest and most bands; a band is eight one-byte signature places, of which bands() says how many make its key.
BANDS, MOST_BANDS, ROWS = 48, 64, 8
#: All bands together may miss a pair at the threshold with this probability.
MISSED = 3e-7
#: Members of a bucket that one task compares with each other or with as many others; larger buckets are dealt to blocks.
BLOCK = 512
#: Pairs whose bands are held at once (up to 1 kB each); bytes of texts that are shingled at once (a longer text alone).
PAIRS, TEXTS = 1 << 14, 1 << 20
#: Members of a bucket, on average, that all its blocks have.
SHARED = 16
#: In groups of more members, only a spanning forest of the most similar pairs is verified at first.
HOT = 32
#: Of a bucket with more blocks of members than this outside its largest component, the members are grouped anew, by rare
#: shingles.
WIDE = 4
#: So many rows of one or two longs may be broadcast, by count; more are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000


def bands(percent: int) -> tuple[int, int]:
    """(number of bands, places in a band's key) for a threshold: the longest keys with which so many bands miss a pair at
    the threshold with a probability of at most MISSED. 48 bands of 8 for 0.85 (2e-7), 64 of 7 for 0.80 (2.9e-7)."""
    for places in range(ROWS, 0, -1):
        hit = (percent / 100) ** places
        least = math.log(MISSED) / math.log1p(-hit) if hit < 1 else 0
        if least <= MOST_BANDS:
            return max(BANDS, 8 * math.ceil(least / 8)), places
    raise ValueError(f"{MOST_BANDS} bands can't find the pairs of a similarity of {percent} percent")


def sketch(docs: DataFrame, n_bands: int, key: int) -> DataFrame:
    """(doc_id, n_shingles, node, bands): node is a 64-bit hash of the whole shingle set, null without shingles."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import set_hash, shingle_sets, signatures

        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                sets = shingle_sets(part.column("text"), key)
                some = [i for i, s in enumerate(sets) if len(s)]
                node, words = np.zeros(len(sets), np.int64), np.zeros((len(sets), n_bands), np.int64)
                if some:
                    full = [sets[i] for i in some]
                    node[some] = set_hash(full).view(np.int64)
                    words[some] = signatures(full, n_bands * ROWS).view(np.int64)
                none = np.ones(len(sets), bool)
                none[some] = False
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n_bands), pa.array(words.ravel()))
                yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, mask=none), lists], names=["doc_id", "n_shingles", "node", "bands"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "doc_id long, n_shingles long, node long, bands array<long>")


def least_matches(similarity: float, places: list[int], miss: float) -> list[int]:
    """For each number of compared one-byte places, the fewest agreements at which the posterior probability (uniform
    prior) that a pair's similarity reaches the threshold is still at least ``miss``."""
    p = similarity + (1 - similarity) / 256  # two unequal minima share a byte by chance
    out = []
    for n in places:
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(p) + (n + 1 - m) * math.log1p(-p))
        out.append(m)
    return out


def _forest(x, y, hits):
    """Of these pairs a spanning forest, the most agreements first."""
    import numpy as np

    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    keep = []
    for k in np.argsort(-hits, kind="stable").tolist():
        a, b = root(int(x[k])), root(int(y[k]))
        if a != b:
            up[a] = b
            keep.append(k)
    return x[keep], y[keep]


def _compare(percent: int, miss: float, forest: bool, banded: bool = True):
    """Rows (bucket, i, j, block, node, root, n, alone, bands), in order of (bucket, i, j): the pairs of each group,
    of different roots, that share this band and none before it, and that neither the sizes of the sets (without the
    ``alone`` shingles that no other set has) nor the posterior rule out. With ``forest``, groups of more than HOT rows
    give a spanning forest of these pairs. Without ``banded``, groups aren't bands' buckets: pairs need share no band."""
    hot = HOT
    n_bands, key_places = bands(percent)
    key_mask = -1 << 8 * (ROWS - key_places)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        places = list(range(64, n_bands * ROWS + 1, 64))
        least = least_matches(percent / 100, places, miss)

        def survivors(x, y, band, root, n, most, bands):
            """The pairs (x[k], y[k]) of rows that stay, and the agreements of each."""
            both = np.minimum(most[x], most[y])
            keep = (both * 100 >= (n[x] + n[y] - both) * percent) & (root[x] != root[y])
            x, y = x[keep], y[keep]
            out = [(x[:0], y[:0], x[:0])]
            for at in range(0, len(x), PAIRS):
                a, b = x[at : at + PAIRS], y[at : at + PAIRS]
                if banded:
                    same = (bands[a] ^ bands[b]) & np.int64(key_mask) == 0
                    first = np.where(same.any(1), same.argmax(1), n_bands)
                    ok = first == band[a]
                    a, b = a[ok], b[ok]
                hits, seen = np.zeros(len(a), np.int64), 0
                for upto, need in zip(places, least, strict=True):
                    u, v = bands[a, seen // ROWS : upto // ROWS], bands[b, seen // ROWS : upto // ROWS]
                    hits += (np.ascontiguousarray(u).view(np.uint8) == np.ascontiguousarray(v).view(np.uint8)).sum(1)
                    ok = hits >= need
                    a, b, hits, seen = a[ok], b[ok], hits[ok], upto
                out.append((a, b, hits))
            return [np.concatenate(z) for z in zip(*out, strict=True)]

        def pairs(t):
            bucket, i, j, block, node, root, n, alone = (t.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "node", "root", "n", "alone"))
            most, band = n - alone, bucket & 63
            bands = np.ascontiguousarray(t.column("bands").combine_chunks().flatten().to_numpy()).reshape(-1, n_bands)
            new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            size = np.diff(np.r_[new, len(bucket)])
            xs, ys, held = [], [], 0
            a, b, whole_group = [], [], False

            def flush():
                nonlocal xs, ys, held
                if xs:
                    p, q, hits = survivors(np.concatenate(xs), np.concatenate(ys), band, root, n, most, bands)
                    if whole_group:
                        p, q = _forest(p, q, hits)
                    a.append(p)
                    b.append(q)
                xs, ys, held = [], [], 0

            for g in np.unique(size[size > 1]):
                at = new[size == g]
                p, q = np.triu_indices(int(g), 1)
                if forest and g > hot and not whole_group:
                    flush()
                    whole_group = True
                step = 1 if whole_group else max(1, (1 << 18) // len(p))
                for k in range(0, len(at), step):
                    x, y = (at[k : k + step, None] + p).ravel(), (at[k : k + step, None] + q).ravel()
                    if g > 2:
                        cross = (i[x] == j[x]) | (block[x] != block[y])
                        x, y = x[cross], y[cross]
                    xs.append(x)
                    ys.append(y)
                    held += len(x)
                    if held >= 1 << 18 or whole_group:
                        flush()
            flush()
            if a:
                p, q = node[np.concatenate(a)], node[np.concatenate(b)]
                return pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])
            return None

        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < 1 << 15:
                continue
            t = pa.concat_tables(held).combine_chunks()
            keys = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
            held.clear()  # t has a copy
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            whole = int(np.argmax(last))  # the last group may go on in the next batch
            if whole and (out := pairs(t.slice(0, whole))) is not None:
                yield out
            held, rows = [t.slice(whole)], t.num_rows - whole
            release()
        if held and (out := pairs(pa.concat_tables(held).combine_chunks())) is not None:
            yield out
        held.clear()
        release()

    return run


def _spread(classes: DataFrame, key_places: int) -> DataFrame:
    """(bucket, node) for each band; the lowest six bits of a bucket are the band's number."""
    key_mask = F.lit(-1 << 8 * (ROWS - key_places)).cast("long")
    each = classes.select("node", F.posexplode("bands").alias("band", "word")).select("node", "band", F.col("word").bitwiseAND(key_mask).alias("key"))
    return each.select("node", F.expr("shiftleft(shiftright(xxhash64(band, key), 6), 6) | band").alias("bucket"))


def _files(rows: int, per: int = 500_000) -> int:
    return 1 + rows // per


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


_KEPT = ("bucket", "node", "root", "n", "alone", "bands")


def _compared(dealt: DataFrame, percent: int, miss: float, forest: bool, banded: bool = True) -> DataFrame:
    grouped = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return grouped.mapInArrow(_compare(percent, miss, forest, banded), "a long, b long")


def candidates(members: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a < b) of nodes that share a band and survive the sequential test: all of small buckets, a spanning forest
    of each block of larger ones. A bucket's blocks have some members in common, so that the forests of a dense group hang
    together; what doesn't is left to _remaining(). members: (bucket, members, node, root, alone); classes: (node, n,
    bands). The rows dealt grow as the members do, whatever the size of a bucket."""
    blocks = F.ceil(F.col("members") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    common = (blocks > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("members")) < SHARED)
    dealt = members.join(classes, "node").select(*_KEPT, F.explode(F.when(common, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own))).alias("i"))
    return _compared(dealt.select(*_KEPT, "i", F.col("i").alias("j"), F.lit(0).cast("long").alias("block")), percent, miss, True)


def _shapes(open_: DataFrame) -> DataFrame:
    """(bucket, top, by_short, blocks, outer): the root of each bucket's largest component, which members are compared with
    all (the ``short`` ones or, if these are fewer, those outside that component), the blocks of all members and of these.
    open_: (bucket, node, root, alone, short)."""
    sizes = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if("short").alias("s"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"), F.sum("s").alias("short"))
    outside = F.col("all") - F.col("top.c")
    few = F.least("short", outside)
    shapes = largest.select("bucket", F.col("top.root").alias("top"), (F.col("short") < outside).alias("by_short"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil(few / BLOCK).alias("outer"))
    return shapes.where("outer > 0")


def _across(open_: DataFrame, shapes: DataFrame, classes: DataFrame, percent: int, miss: float, banded: bool) -> DataFrame:
    """Pairs between the components of a bucket: the few members that _shapes() says against all members, block by block.
    Only pairs with a ``short`` member are wanted. open_: (bucket, node, root, alone, short)."""
    rows = open_.join(shapes, "bucket").join(classes, "node")
    mine, own = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("outer"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    every = rows.select(*_KEPT, F.explode(F.sequence(one, F.col("outer"))).alias("i"), (-1 - mine).alias("j"), zero.alias("block"))
    few = rows.where("if(by_short, short, root <> top)").select(*_KEPT, (own + 1).alias("i"), F.explode(F.sequence(-F.col("blocks"), -one)).alias("j"), one.alias("block"))
    return _compared(every.union(few), percent, miss, False, banded)


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, root, alone, short): the nodes (node, root, alone) grouped by each of their rarest shingles. Take t =
    percent / 100 and all shingles in one order, here from the rarest. Of two sets of x <= y shingles with a similarity of t at
    least, at least t * y and 2 * t / (1 + t) * x are common, so one of the first x - ceil(2 * t / (1 + t) * x) + 1 of the
    smaller set (``short`` rows) is among the first y - ceil(t * y) + 1 of the larger. No such pair is lost."""
    each = nodes.join(sets, "node").select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    counted = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "s"))
    ranked = each.join(counted, "s").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    short = F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    return ranked.where("c > 1").select(F.col("s").alias("bucket"), "node", short.alias("short")).join(nodes, "node").select("bucket", "node", "root", "alone", "short")


def _mixed(members: DataFrame, files: int) -> DataFrame:
    """The rows of members (bucket, node, root, alone, short) in buckets with more than one component and a short member."""
    mixed = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("short").alias("short")).where("lo <> hi and short").select("bucket")
    return Table(members.join(Table(mixed, "mixed", files).df, "bucket"), "open", files).df


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    counted = _small(pairs, pairs.count()).join(left, "a").join(right, "b").select("a", "b", common.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return counted.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")


def _remaining(classes: DataFrame, hot: DataFrame, sets: DataFrame, roots: DataFrame, rows: int, percent: int, miss: float) -> DataFrame:
    """What the forests of hot buckets (bucket, members, node; at most so many rows) have left open: their pairs across components. A shingle
    that one candidate alone has can be in no intersection: a text with too many of these has no link at all, and most
    pairs of texts with edits of their own are ruled out before any comparison."""
    shingles = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    n = sets.count()
    sizes = sets.select("node", F.size("shingles").alias("n"))
    alone = Table(shingles.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "alone", _files(n))
    known = sets.select("node").join(roots, "node", "left").join(alone.df, "node", "left")
    known = Table(known.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("alone", F.lit(0)).cast("long").alias("alone")), "known", _files(n))
    usable = known.df.join(sizes, "node").where((F.col("n") - F.col("alone")) * 100 >= F.col("n") * percent).select("node", "root", "alone")
    members = Table(hot.join(_small(usable, n), "node").select("bucket", "node", "root", "alone", F.lit(True).alias("short")), "hot", _files(rows))
    open_ = _mixed(members.df, _files(rows))
    nodes = Table(open_.select("node").distinct(), "nodes", _files(n)).df
    few = classes.join(_small(nodes, nodes.count()), "node", "left_semi")
    shapes = Table(_shapes(open_), "shapes", _files(rows)).df
    found = _across(open_, shapes.where(F.col("outer") <= WIDE), few, percent, miss, True)
    wide = shapes.where(F.col("outer") > WIDE).select("bucket")
    if not wide.isEmpty():
        crowd = Table(open_.join(wide, "bucket").select("node", "root", "alone").distinct(), "crowd", _files(n)).df
        by = _mixed(Table(_by_rare_shingles(crowd, sets, percent), "rare").df, _files(rows))
        found = found.union(_across(by, _shapes(by), few, percent, miss, False))
    return found.distinct()


def _sets(docs: DataFrame, key: int) -> DataFrame:
    def rows(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import set_hash, shingle_sets

        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                sets = [s for s in shingle_sets(part.column("text"), key) if len(s)]
                if sets:
                    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                    yield pa.record_batch([pa.array(set_hash(sets).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    return docs.mapInArrow(rows, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, percent: int = 80, miss: float = 1e-7, key: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, the row's own
    included), kept (doc_id = component_id). Two documents are linked if their sets of five-word shingles have
    100 * intersection >= percent * union.

    Equal sets become one node before anything else, so copies cost nothing. Nodes that share a band are compared by
    batches of 64 signature places; a pair goes as soon as its posterior chance to reach the threshold falls below
    ``miss``. Surviving pairs are confirmed on the two full sets; only texts of such pairs are shingled again. Of a hot
    bucket a spanning forest of survivors is confirmed first, then every survivor between components that are still
    apart: pairs within a component can't change the result.

    Sets are compared as sets of 64-bit hashes, which are equal for two different shingles with a probability of 2**-64. The
    hash has a key, drawn anew for each call unless given, so that nobody can write texts whose shingles collide.

    Texts that are null, empty or without words have no set: n_shingles 0, alone in their component. A null doc_id takes
    part with its text and is never kept; its component_id is null if all its component's ids are. Repeated rows with the
    same doc_id are copies of each other; both stay. Other columns are ignored."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bands, key_places = bands(percent)
    key = secrets.randbits(64) if key is None else key
    sketches = Table(sketch(plain, n_bands, key), "sketch")
    n_docs = sketches.df.count()
    grouped = sketches.df.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = Table(grouped, "classes", _files(n_docs, 20_000))
    sized = classes.df.select("node", "n", "bands")
    counts = _spread(sized, key_places).groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    counts = Table(counts, "buckets", _files(n_docs, 50_000))
    rows, n_buckets = counts.df.agg(F.coalesce(F.sum("members"), F.lit(0)).cast("long"), F.count(F.lit(1))).first()
    members = Table(_spread(sized, key_places).join(_small(counts.df, n_buckets), "bucket").select("bucket", "members", "node"), "members", _files(n_docs, 20_000))
    counts.drop()
    first = members.df.select("bucket", "members", "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("alone"))
    pairs = Table(candidates(first, sized, percent, miss), "pairs", _files(rows, 20_000))
    n_pairs = pairs.df.count()
    # in a bucket of several blocks a member may have its only partner in another block
    several = members.df.where(F.col("members") > BLOCK).select("node")
    nodes = pairs.df.select(F.col("a").alias("node")).union(pairs.df.select("b")).union(several).distinct()
    nodes = Table(nodes, "nodes", _files(n_pairs + rows))
    n = nodes.df.count()
    wanted = classes.df.select("node", "doc_id").join(_small(nodes.df, n), "node")
    ids = _small(wanted.select("doc_id").where("doc_id is not null").distinct(), n)
    again = plain.join(ids, "doc_id", "left_semi").select("text")
    if not plain.where("doc_id is null").isEmpty():
        again = again.union(plain.where("doc_id is null").select("text"))
    # a set may come more than once (repeated ids), or from another text under the same id
    once = _sets(again, key).groupBy("node").agg(F.first("shingles").alias("shingles")).join(_small(nodes.df, n), "node", "left_semi")
    sets = Table(once, "sets", _files(n, 5_000))
    links = Table(_verified(pairs.df, sets.df, percent), "links", _files(n_pairs, 5_000))
    roots = Table(components(links.df), "roots", _files(n))
    hot = members.df.where(F.col("members") > HOT)
    if not hot.isEmpty():
        rest = Table(_remaining(sized, hot, sets.df, roots.df, rows, percent, miss), "rest", _files(rows, 20_000))
        more = Table(_verified(rest.df, sets.df, percent), "more-links", _files(rest.df.count(), 5_000))
        if not more.df.isEmpty():
            roots = Table(components(links.df.union(more.df)), "roots", _files(n))
    for t in (members, pairs, nodes, sets, links):
        t.drop()
    mine = classes.df.select("node", "doc_id").join(roots.df, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    mine = Table(mine, "rooted", _files(n_docs))
    least = Table(mine.df.groupBy("root").agg(F.min("doc_id").alias("component")), "least", _files(n_docs))
    named = Table(mine.df.join(least.df, "root").select("node", "component"), "named", _files(n_docs))
    for t in (mine, least, roots, classes):
        t.drop()
    rows = sketches.df.select("doc_id", "n_shingles", "node")
    joined = rows.where("node is not null").join(named.df, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents with one row of each group of near-duplicates, that with the smallest doc_id (null ids last, ties to any);
    all columns stay. Rows count one by one: of rows that repeat a doc_id and a text one stays, and a null doc_id is no
    reason to go. Rows without words are in no group and all stay. Empty table: empty result."""
    own = "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "row"  # longer than any name of docs
    rows = Table(docs.withColumn(own, F.monotonically_increasing_id()), "rows").df
    found = Table(near_duplicates(rows.select(F.col(own).alias("doc_id"), F.col("text")), percent).select(F.col("doc_id").alias(own), "component_id"), "found").df
    groups = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    groups = Table(groups, "groups", _files(n := rows.count())).df
    named = rows.select(own, F.col("doc_id").cast("long").alias("id"))
    members = Table(found.join(_small(groups, groups.count()), "component_id").join(named, own), "members", _files(n)).df
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", own)).alias("first")).select(F.col(f"first.{own}").alias(own))
    gone = Table(members.join(_small(first, groups.count()), own, "left_anti").select(own), "gone", _files(n)).df
    return rows.join(_small(gone, gone.count()), own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
