"""Exact top-k by inner product (ball trees) and approximate nearest neighbours (one-bit codes), on one search plan."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table, drop_path, filesystem, new_path, put_file

#: A shard has about this many vectors, more as the table grows (so that their number stays in bounds), up to so many bytes.
SHARD_ROWS, SHARD_BYTES = 8192, 64 << 20
#: Queries that one task holds at once.
QUERY_ROWS = 1024
#: Each round of a search visits so many times the shards of all rounds before it, and one at first.
ROUND = 7
#: Vectors in a leaf of a ball tree; bits of a component of a query that meets one-bit codes.
LEAF, QUERY_BITS = 128, 4


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the vectors without null or non-finite components; empty vectors go too."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(good).withColumn("dim", F.size("v"))


def one_each(queries: DataFrame) -> DataFrame:
    """finite() rows with one vector for each vec_id: of several, the one that sorts first."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _save(uri: str, arrays: dict) -> None:
    """Each array as a file of its own: a memory map of one doesn't touch the others."""
    import numpy as np

    for name, a in arrays.items():
        buffer = io.BytesIO()
        np.lib.format.write_array(buffer, np.ascontiguousarray(a))
        put_file(f"{uri}.{name}.npy", lambda stream, b=buffer: stream.write(b.getbuffer()))


def _load(uri: str, name: str):
    import numpy as np

    fs, path = filesystem(f"{uri}.{name}.npy")
    if fs.type_name == "local":
        return np.load(path, mmap_mode="r")
    with fs.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


def _arrays(table):
    import numpy as np

    ids = table.column("vec_id").to_numpy()
    return ids, np.ascontiguousarray(table.column("v").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)


def _slim(x):
    """x in single precision where that is exact."""
    import numpy as np

    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if (small == x).all() else x


def search(vectors: DataFrame, queries: DataFrame, k: int, build: Callable, kernel: Callable, kind: str) -> DataFrame:
    """Each query's k best rows of ``vectors``, its own id excepted; both are (vec_id, v, dim), queries with one row an id.

    The vectors are dealt evenly to shards (by place in the table too, so that repeated ids spread). build(ids, x) gives the
    arrays of a shard's index, which is written once, and read by memory map where the folder allows. Queries come in
    chunks of about QUERY_ROWS. A task takes one chunk through some shards one after the other and carries each query's
    kth score from shard to shard; a round of tasks visits ROUND times as many shards as those before it, and starts
    with the kth scores of them all. Every chunk starts at another shard. A task holds one shard's index and one chunk,
    whatever the number of either, so both grow only the number of tasks. The driver sees a row for each shard.

    kernel(index, qid, q, best) adds to best, a _Best, what may be among the k best; index(name) gives an array."""
    spark = vectors.sparkSession
    folder = new_path(spark, "vectors")
    schema = f"dim int, chunk int, query_id long, vec_id long, score {kind}"
    n_of = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # a row for each length of vectors
    q_of = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    sizes = []
    for dim, n in n_of.items():
        rows = max(1, min(SHARD_BYTES // (8 * dim), max(SHARD_ROWS, n // 512)))
        if dim in q_of:
            sizes.append((dim, -(-n // rows), -(-q_of[dim] // QUERY_ROWS)))
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    of = F.broadcast(spark.createDataFrame(sizes, "dim int, shards int, chunks int"))

    def write_shard(key, rows):
        import pyarrow as pa

        dim, shard = (v.as_py() for v in key)
        ids, x = _arrays(rows)
        _save(f"{folder}/d{dim}-s{shard}", build(ids, x))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())})

    def write_chunk(key, rows):
        import pyarrow as pa

        dim, chunk = (v.as_py() for v in key)
        ids, x = _arrays(rows)
        _save(f"{folder}/d{dim}-q{chunk}", {"id": ids, "v": x})
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([chunk], pa.int32())})

    place = F.monotonically_increasing_id()
    sharded = vectors.withColumn("place", place).join(of, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "place"), F.col("shards")).cast("int")).select("vec_id", "v", "dim", "shard")
    filled = {(r["dim"], r["shard"]) for r in sharded.groupBy("dim", "shard").applyInArrow(write_shard, "dim int, shard int").collect()}
    chunked = queries.join(of, "dim").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).select("vec_id", "v", "dim", "chunk")
    asked = {(r["dim"], r["shard"]) for r in chunked.groupBy("dim", "chunk").applyInArrow(write_chunk, "dim int, shard int").collect()}

    def run(number: int, bounded: set):
        def visit(batches):
            import numpy as np
            import pyarrow as pa

            for unit in (u for b in batches for u in b.to_pylist()):
                dim, chunk = unit["dim"], unit["chunk"]
                qid, q = np.asarray(_load(f"{folder}/d{dim}-q{chunk}", "id")), np.asarray(_load(f"{folder}/d{dim}-q{chunk}", "v"))
                best = _Best(len(qid), k, kind)
                if (dim, chunk) in bounded:
                    seen, bound = (_load(f"{folder}/d{dim}-b{number}-{chunk}", c) for c in ("id", "bound"))
                    at = np.searchsorted(seen, qid)
                    known = at < len(seen)
                    known[known] = seen[at[known]] == qid[known]
                    best.shared[known] = bound[at[known]]
                for j in range(unit["first"], unit["until"]):
                    shard = (chunk + j) % unit["shards"]
                    if (dim, shard) in filled:
                        kernel(lambda name, uri=f"{folder}/d{dim}-s{shard}": _load(uri, name), qid, q, best)
                who, at = np.nonzero(best.id != best.none)
                same = [pa.array(np.full(len(who), v, np.int32)) for v in (dim, chunk)]
                yield pa.record_batch([*same, pa.array(qid[who]), pa.array(best.id[who, at]), pa.array(best.score[who, at])], names=["dim", "chunk", "query_id", "vec_id", "score"])

        return visit

    def write_bounds(number: int):
        def write(key, rows):
            import numpy as np
            import pyarrow as pa

            dim, chunk = (v.as_py() for v in key)
            ids = rows.column("query_id").to_numpy()
            order = np.argsort(ids)
            _save(f"{folder}/d{dim}-b{number}-{chunk}", {"id": ids[order], "bound": rows.column("score").to_numpy()[order]})
            return pa.table({"dim": pa.array([dim], pa.int32()), "chunk": pa.array([chunk], pa.int32())})

        return write

    best, start, number, bounded = None, 0, 0, set()
    cores = spark.sparkContext.defaultParallelism
    while start < max(s for _, s, _ in sizes):
        stop = start + max(1, ROUND * start)
        open_ = [(dim, shards, chunk, start, min(stop, shards)) for dim, shards, chunks in sizes if start < shards for chunk in range(chunks) if (dim, chunk) in asked]
        step = max(1, sum(until - first for *_, first, until in open_) // (4 * cores))
        units = [(dim, shards, chunk, lo, min(lo + step, until)) for dim, shards, chunk, first, until in open_ for lo in range(first, until, step)]
        tasks = spark.createDataFrame(units, "dim int, shards int, chunk int, first int, until int").repartition(len(units))
        found = tasks.mapInArrow(run(number, bounded), schema)
        if best is not None:
            found = found.union(best.df.select("dim", "chunk", "query_id", "vec_id", "score"))
        merged = Table(top(found, k), "found", 1 + sum(q_of.values()) * k // 500_000)
        if best is not None:
            best.drop()
        best, start, number = merged, stop, number + 1
        if start < max(s for _, s, _ in sizes):
            kth = best.df.where(F.col("rank") == k).select("dim", "chunk", "query_id", "score")
            bounded = {tuple(r) for r in kth.groupBy("dim", "chunk").applyInArrow(write_bounds(number), "dim int, chunk int").collect()}
    drop_path(spark, folder)
    return best.df.select("query_id", "rank", "vec_id", "score")


class _Best:
    """The k best (score, id) of each query so far, and the kth score that other shards have given it."""

    def __init__(self, m: int, k: int, kind: str):
        import numpy as np

        dtype = np.int64 if kind == "long" else np.float64
        self.k, self.none = k, np.iinfo(np.int64).max
        self.low = -(2**63 - 1) if kind == "long" else -np.inf  # below any score
        self.score = np.full((m, k), self.low, dtype)
        self.id = np.full((m, k), self.none)
        self.shared = np.full(m, self.low, dtype)

    def bound(self, rows):
        import numpy as np

        return np.maximum(self.score[rows, -1], self.shared[rows])

    def add(self, rows, ids, scores):
        """ids: (n,) or (rows, n); scores (rows, n); an id of the largest integer is none."""
        import numpy as np

        ids = np.broadcast_to(ids, scores.shape)
        s, i = np.concatenate([self.score[rows], scores], 1), np.concatenate([self.id[rows], ids], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


# ---- exact top-k -----------------------------------------------------------------------------------------------------


def ball_tree(x):
    """Levels of (centre, radius, start, end) arrays over a permutation of the rows of x; node j of a level has the nodes
    2j and 2j+1 of the next. Each split is at the median of the projection on the line through two far points."""
    import numpy as np

    order = np.arange(len(x))
    depth = max(0, int(np.ceil(np.log2(max(1, len(x) / LEAF)))))
    cuts, levels = [0, len(x)], []
    for level in range(depth + 1):
        centres, radii = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = x[order[lo:hi]]
            c = part.mean(0) if hi > lo else np.zeros(x.shape[1])
            centres.append(c)
            radii.append(np.sqrt(((part - c) ** 2).sum(1)).max() if hi > lo else 0.0)
        levels.append((np.array(centres), np.array(radii) * (1 + 1e-12), np.array(cuts[:-1]), np.array(cuts[1:])))
        if level == depth:
            break
        new = [0]
        for (lo, hi), c in zip(zip(cuts[:-1], cuts[1:], strict=True), centres, strict=True):
            part, mid = x[order[lo:hi]], (lo + hi) // 2
            if hi > lo:
                a = part[((part - c) ** 2).sum(1).argmax()]
                b = part[((part - a) ** 2).sum(1).argmax()]
                order[lo:hi] = order[lo:hi][np.argsort(part @ (a - b), kind="stable")]
            new += [mid, hi]
        cuts = new
    return order, levels


def _tree_index(ids, x) -> dict:
    """Rows in the tree's order, and its levels one after the other."""
    import numpy as np

    order, levels = ball_tree(x)
    centre, radius, start, end = (np.concatenate(part) for part in zip(*levels, strict=True))
    return {"id": ids[order], "x": _slim(x[order]), "largest": np.array([np.abs(x).max(initial=0)]), "centre": centre, "radius": radius, "start": start, "end": end}


def _inner_products(q, x, largest: float):
    """Exact inner products of whole numbers: 64-bit integers, or Python's own where these may not do."""
    import numpy as np

    reach = largest * float(np.abs(q).max(initial=0)) * x.shape[1]
    if reach < 2**52:  # then sums of doubles are exact
        return (q @ x.T).astype(np.int64)
    if reach < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (q, x)]
    return whole[0] @ whole[1].T


def _inner_product_kernel(index, qid, q, best) -> None:
    import numpy as np

    ids, x, largest = index("id"), index("x"), float(index("largest")[0])
    centre, radius, start, end = (np.asarray(index(c)) for c in ("centre", "radius", "start", "end"))
    norm = np.sqrt((q * q).sum(1))
    leaves = (len(radius) + 1) // 2
    starts, ends = start[-leaves:], end[-leaves:]
    for at in range(0, len(qid), 1024):
        mine = np.arange(at, min(at + 1024, len(qid)))
        upper = np.full((len(mine), 1), np.inf)
        lo, width = 0, 1
        while lo < len(radius):  # from the root down: a child's bound is no higher than its parent's
            if width > 1:
                upper = np.repeat(upper, 2, 1)
            bound = q[mine] @ centre[lo : lo + width].T + norm[mine, None] * radius[lo : lo + width]
            upper = np.minimum(upper, bound + 1e-9 * (np.abs(bound) + norm[mine, None]) + 1e-6)
            upper[upper < best.bound(mine)[:, None]] = -np.inf  # a pruned branch stays pruned
            lo, width = lo + width, 2 * width
        leaf_order = np.argsort(-upper, 1, kind="stable")
        active = np.arange(len(mine))
        for turn in range(upper.shape[1]):  # each query's leaves by falling bound, all queries a leaf at a time
            leaf = leaf_order[active, turn]
            go = (upper[active, leaf] >= best.bound(mine[active])) & (upper[active, leaf] > -np.inf)
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                j, who = int(leaf[group[0]]), mine[active[group]]
                part = slice(int(starts[j]), int(ends[j]))
                score = _inner_products(q[who], np.asarray(x[part], np.float64), largest)
                leaf_ids = np.broadcast_to(ids[part], score.shape)
                own = leaf_ids == qid[who, None]
                if own.any():
                    leaf_ids, score = np.where(own, best.none, leaf_ids), np.where(own, best.low, score)
                if score.dtype == object and any(abs(v) >= 2**63 for v in score.ravel()):
                    raise ValueError("an inner product doesn't fit in 64 bits")
                best.add(who, leaf_ids, score.astype(np.int64))


def top_k_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact: for each row of ``queries`` (a subset of ``vectors`` by vec_id) its k rows of highest inner product, itself
    excepted: query_id, rank, vec_id, score. Both: vec_id and embedding, of whole numbers; score is a 64-bit integer.

    A ball tree is built in each shard and written. For a ball of centre c and radius r no inner product with q exceeds
    q.c + |q| r; branches below the current kth score, which a query carries from shard to shard, are cut, and each
    query visits the leaves that are left by falling bound.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id; vectors
    of different lengths don't meet. Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates of their own;
    of such queries the vector that sorts first asks. Fewer candidates than k: all. Empty tables: no rows. Other columns are
    ignored. An inner product beyond 64 bits is refused with an error."""
    return search(finite(vectors), one_each(finite(queries)), k, _tree_index, _inner_product_kernel, "long")


# ---- one-bit codes ---------------------------------------------------------------------------------------------------


def rotation(dim: int, seed: int = 20):
    """A random orthogonal matrix, the same on every executor."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x):
    """Rows times a power of two each, so that squares neither overflow nor vanish; nothing is rounded."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def pack_bits(positive):
    """Rows of booleans as little-endian 64-bit words, the last one filled up with zeros."""
    import numpy as np

    pad = -positive.shape[1] % 64
    return np.packbits(np.pad(positive, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")


def encode_bits(x):
    """(signs of the rotated unit rows as words of bits, correction: the inner product of each unit row with its code)."""
    import numpy as np

    x = scaled(x)
    turned = (x / np.sqrt((x * x).sum(1))[:, None]) @ rotation(x.shape[1]).T
    return pack_bits(turned > 0), np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def query_planes(turned):
    """A rotated unit query in QUERY_BITS bits a component: (lowest, step, bit planes as words, length of what is lost)."""
    import numpy as np

    low, high = float(turned.min()), float(turned.max())
    step = (high - low) / (2**QUERY_BITS - 1) or 1.0
    level = np.rint((turned - low) / step).astype(np.int64)
    planes = pack_bits((level[None, :] >> np.arange(QUERY_BITS)[:, None] & 1).astype(bool))
    return low, step, planes, float(np.sqrt(((low + step * level - turned) ** 2).sum()))


def estimates(bits, ones, factor, query):
    """Estimated cosines of a query with all codes: bit counts of the codes and each plane give the sum of the query's
    components where a code has a one. ones: bits set in each code; factor: 1 / (sqrt(dim) * correction)."""
    import numpy as np

    low, step, planes, _, total = query
    held = np.zeros(len(bits), np.int64)
    for j, plane in enumerate(planes):
        held += np.bitwise_count(bits & plane).sum(1, dtype=np.int64) << j
    return (2 * (low * ones + step * held) - total) * factor


def _code_index(epsilon: float):
    def build(ids, x) -> dict:
        """Codes apart from the vectors: 1 bit a component and three numbers a row."""
        import numpy as np

        dim = x.shape[1]
        bits, correction = encode_bits(x)
        error = epsilon * np.sqrt(np.maximum(0, 1 / correction**2 - 1)) / np.sqrt(max(1, dim - 1)) + 1e-6
        ones = np.bitwise_count(bits).sum(1, dtype=np.int32)
        return {"id": ids, "x": _slim(x), "bits": bits, "ones": ones, "factor": (1 / (np.sqrt(dim) * correction)).astype(np.float32), "error": error.astype(np.float32)}

    return build


def _one_bit_kernel(epsilon: float):
    def kernel(index, qid, q, best) -> None:
        import numpy as np

        ids, bits, ones, factor, error = (np.asarray(index(c)) for c in ("id", "bits", "ones", "factor", "error"))
        x = index("x")
        q = scaled(q)
        q_norm = np.sqrt((q * q).sum(1))
        turned = (q / q_norm[:, None]) @ rotation(q.shape[1]).T
        k = best.k
        for m in range(len(qid)):
            low, step, planes, lost = query_planes(turned[m])
            about = estimates(bits, ones, factor, (low, step, planes, lost, low * q.shape[1] + step * sum(int(np.bitwise_count(p).sum()) << j for j, p in enumerate(planes))))
            wide = error + epsilon * lost * factor
            about[ids == qid[m]] = -np.inf
            upper, floor = about + wide, best.bound(m)
            if len(ids) > k:
                floor = max(floor, np.partition(about - wide, -k)[-k])
            chosen = np.flatnonzero(upper >= floor)
            chosen = chosen[np.argsort(-upper[chosen], kind="stable")]
            for lo in range(0, len(chosen), 256):
                part = chosen[lo : lo + 256]
                if upper[part[0]] < best.bound(m) or upper[part[0]] == -np.inf:
                    break
                part = part[upper[part] > -np.inf]
                rows = scaled(np.asarray(x[part], np.float64))
                score = (rows * q[m]).sum(1) / (np.sqrt((rows * rows).sum(1)) * q_norm[m])
                best.add(np.array([m]), ids[part][None, :], score[None, :])

    return kernel


def nearest_by_codes(vectors: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = 1.9) -> DataFrame:
    """Approximate: for each row of ``queries`` (a subset of ``vectors`` by vec_id) k rows of largest cosine, itself
    excepted: query_id, rank, vec_id, score. Both: vec_id and embedding.

    Every vector is scaled to unit length, turned by one random rotation and kept as the signs of its components, packed
    to bits, with its inner product with its own code. These codes are written apart from the vectors, once for each shard.
    A query is turned as well and rounded to QUERY_BITS bits a component; counts of common bits give an unbiased estimate
    of its cosine with every code, which errs by more than ``epsilon`` standard errors only rarely. Rows whose upper bound
    reaches the kth lower bound, or the kth exact score that a query brings from other shards, are fetched and scored
    exactly, best bound first.

    score is the cosine in double precision on the original vectors (times powers of two, so that no square overflows or
    vanishes). Null, empty or zero vectors, null or non-finite components and rows without vec_id take no part; vectors of
    different lengths don't meet. Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates of their own; of
    such queries the vector that sorts first asks. Fewer candidates than k: all. Empty tables: no rows. Other columns are
    ignored."""
    nonzero = F.exists("v", lambda x: x != 0)
    return search(finite(vectors).where(nonzero), one_each(finite(queries).where(nonzero)), k, _code_index(epsilon), _one_bit_kernel(epsilon), "double")
