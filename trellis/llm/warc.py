"""WARC files and the Merkle fixity audit of their replicas."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Table, filesystem, new_path, put_file

#: Records in a file, on average; children of a node; stored bytes that a task reads, unless one file has more.
FILE_ROWS, FANOUT, TASK_BYTES = 2000, 16, 8 << 20
INDEX = "file long, record int, page_id long, offset long, length long, digest string"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC/1.1 resource record. A null html is an empty block, a null url the record's own id."""
    block = (html or "").encode("utf-8", "surrogatepass")
    name = f"urn:page:{'' if page_id is None else page_id}"
    target = re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {target}\r\nContent-Type: text/html\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of uncompressed WARC data; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        if end + 4 + n + 4 > len(data):
            raise ValueError(f"the record at {at} is cut short")
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored length, content) of the gzip members of a file."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        content = d.decompress(data[at:])
        n = len(data) - at - len(d.unused_data)
        if not d.eof:
            raise ValueError(f"the member at {at} is cut short")
        yield at, n, content
        at += n


def _files(index: DataFrame) -> DataFrame:
    """The index dealt to tasks by whole files, in order; as many tasks as the stored bytes deserve."""
    size, files = index.agg(F.sum("length"), F.countDistinct("file")).first()
    tasks = max(1, min(files, -(-(size or 0) // TASK_BYTES)))
    return index.repartitionByRange(tasks, "file").sortWithinPartitions("file", "record")


def write_warc(pages: DataFrame, out: str | None = None) -> tuple[str, DataFrame]:
    """Write pages as WARC files of one gzip member a record; returns the folder and the index (INDEX) of all records, with
    the hash of what was written.

    Records are dealt to files by a hash of (page_id, url, html), about FILE_ROWS each, and ordered by these in them, so that
    the same table gives the same bytes wherever and however often a task runs. A row that comes more than FILE_ROWS times
    is spread over files by its place in the table. A file appears when complete. Null columns are values like others. Repeated
    rows are records of their own. Empty table: no file."""
    spark = pages.sparkSession
    out = out or new_path(spark, "warc")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    content = F.xxhash64("page_id", "url", "html")
    counts = plain.groupBy(content.alias("content")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_list(F.when(F.col("n") > FILE_ROWS, F.col("content"))).alias("often")).first()
    files = max(1, -(-counts["n"] // FILE_ROWS))  # no more rows come so often than there are files

    def write(batches):
        import pyarrow as pa

        rows = ((f, p, u, h) for b in batches for s in range(0, b.num_rows, 256) for f, p, u, h in zip(*(b.slice(s, 256).column(c).to_pylist() for c in ("file", "page_id", "url", "html")), strict=True))
        for number, group in itertools.groupby(rows, key=lambda r: r[0]):
            index: list[tuple] = []

            def save(stream, group=group, index=index):
                at = 0
                for _, page, url, html in group:
                    stored = gzip.compress(record(page, url, html), 3, mtime=0)
                    stream.write(stored)
                    index.append((page, at, len(stored), hashlib.sha256(stored).hexdigest()))
                    at += len(stored)

            put_file(f"{out}/{number:08d}.warc.gz", save)
            n = len(index)
            cols = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32())] + [pa.array([r[i] for r in index], pa.int64()) for i in range(3)]
            yield pa.record_batch([*cols, pa.array([r[3] for r in index])], names=["file", "record", "page_id", "offset", "length", "digest"])

    salt = F.monotonically_increasing_id()
    number = F.pmod(F.when(content.isin(counts["often"]), F.xxhash64(content, salt)).otherwise(content), F.lit(files))
    dealt = plain.withColumn("file", number).repartitionByRange("file").sortWithinPartitions("file", "page_id", "url", "html")
    return out, Table(dealt.mapInArrow(write, INDEX), "warc-index").df


def replicate(index: DataFrame, folder: str, out: str | None = None, damage: str | None = None) -> str:
    """Copy the files of an index to another folder, byte by byte. For drills: of records for which ``damage``, a SQL condition
    on the columns of the index, holds, the last stored byte but 9 is changed on the way. Returns the folder."""
    out = out or new_path(index.sparkSession, "replica")
    marked = index.withColumn("bad", F.coalesce(F.expr(damage), F.lit(False)) if damage else F.lit(False))

    def copy(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in b.select(["file", "offset", "length", "bad"]).to_pylist())
        for number, group in itertools.groupby(rows, key=lambda r: r["file"]):
            fs, path = filesystem(f"{folder}/{number:08d}.warc.gz")

            def save(stream, group=group, fs=fs, path=path):
                with fs.open_input_file(path) as source:
                    for r in group:
                        source.seek(r["offset"])
                        data = source.read(r["length"])
                        if r["bad"]:
                            at = max(0, len(data) - 9)
                            data = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
                        stream.write(data)

            put_file(f"{out}/{number:08d}.warc.gz", save)
            yield pa.record_batch([pa.array([number], pa.int64())], names=["file"])

    _files(marked).mapInArrow(copy, "file long").count()
    return out


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """url, page_id (of our own record ids, else null) and html of the resource and response records of WARC files, plain
    or compressed; HTTP headers of responses go."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = filesystem(path)
                with fs.open_input_stream(p, compression=None) as f:
                    data = f.read()
                parts = (c for _, _, c in members(data)) if data[:2] == b"\x1f\x8b" else iter([data])
                out: list[tuple] = []
                for head, block in (r for part in parts for r in parse(part)):
                    if head.get("warc-type") in ("resource", "response"):
                        body = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else block
                        own = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-record-id", ""))
                        out.append((head.get("warc-target-uri"), int(own[1]) if own else None, body.decode("utf-8", "replace")))
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["url", "page_id", "html"])

    schema = "url string, page_id long, html string"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(read, schema)


NODES = "file long, level int, node int, start long, end long, digest string, page_id long, record_bytes long, record_sha256 string"


def fixity_tree(index: DataFrame, folder: str | None = None) -> DataFrame:
    """The Merkle trees of a replica's files, one row a node (NODES), or, without a folder, those of what the index says was
    written. Level 0: each record's stored bytes. Level l + 1: the offset ranges and digests of FANOUT consecutive nodes of
    level l; the last level of a file is its root, which also covers bytes behind the last record. What a replica lacks has the
    digest 'missing'. Records also give the length and hash of their uncompressed content (null if damaged)."""

    def build(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in b.to_pylist())
        for number, group in itertools.groupby(rows, key=lambda r: r["file"]):
            out: list[tuple] = []
            level: list[tuple[int, int, str]] = []
            source = None
            if folder is not None:
                fs, path = filesystem(f"{folder}/{number:08d}.warc.gz")
                try:
                    source = fs.open_input_file(path)
                except FileNotFoundError:
                    pass
            for r in group:
                size = digest = None
                stored = r["digest"] if folder is None else "missing"
                if source is not None and r["offset"] < source.size():
                    source.seek(r["offset"])
                    data = source.read(r["length"])
                    stored = hashlib.sha256(data).hexdigest()
                    try:
                        content = gzip.decompress(data)
                        size, digest = len(content), hashlib.sha256(content).hexdigest()
                    except (OSError, EOFError, zlib.error):
                        pass
                level.append((r["offset"], r["offset"] + r["length"], stored))
                out.append((number, 0, r["record"], *level[-1], r["page_id"], size, digest))
            tail = ""
            if source is not None:
                if source.size() > level[-1][1]:
                    source.seek(level[-1][1])
                    h = hashlib.sha256()
                    while data := source.read(1 << 20):
                        h.update(data)
                    tail = f"and {h.hexdigest()} "
                source.close()
            depth = 0
            while len(level) > 1 or not depth:
                depth += 1
                level = [(part[0][0], part[-1][1], hashlib.sha256("".join(f"{a}-{b}:{d};" for a, b, d in part).encode()).hexdigest()) for part in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
                if len(level) == 1:
                    level = [(*level[0][:2], tail + level[0][2])]
                out += [(number, depth, i, *x, None, None, None) for i, x in enumerate(level)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = [f.split()[0] for f in NODES.split(", ")]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return _files(index).mapInArrow(build, NODES)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two replicas' trees differ: (file, node, start, end) of the mismatching records, and of a file whose records
    agree but not its root (bytes behind the last record: node -1). Roots are compared first; a level's nodes are looked at
    only below the mismatching nodes of the level above."""
    spark = left.sparkSession
    depth = left.agg(F.max("level")).first()[0]
    if depth is None:
        return spark.createDataFrame([], "file long, node int, start long, end long")
    tops = left.groupBy("file").agg(F.max("level").alias("level"))

    def differing(nodes: DataFrame) -> DataFrame:
        a, b = nodes.alias("a"), right.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("file", "level", "node")]
        return a.join(b, same, "left").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("a.file", "a.level", "a.node", "a.start", "a.end")

    files = 1 + left.where("level = 0").count() // 500_000
    bad = Table(differing(left.join(tops, ["file", "level"])), "differing", files)
    named = bad.df.select("file").distinct()
    for level in range(depth - 1, -1, -1):
        if bad.df.isEmpty():
            break
        above = bad.df.where(F.col("level") == level + 1).select("file", F.col("node").alias("parent"))
        here = left.where(F.col("level") == level).withColumn("parent", F.floor(F.col("node") / FANOUT).cast("int"))
        below = differing(here.join(above, ["file", "parent"], "left_semi").drop("parent"))
        bad = Table(below.union(bad.df.where(F.col("level") <= level)), "differing", files)
    found = bad.df.where("level = 0").select("file", "node", "start", "end")
    rest = left.join(tops, ["file", "level"]).join(named.join(found.select("file"), "file", "left_anti"), "file", "left_semi")
    return found.union(rest.select("file", F.lit(-1).alias("node"), F.col("end").alias("start"), "end"))


def audit_pages(pages: DataFrame, damage: str | None = None) -> DataFrame:
    """Write pages as WARC files, copy these to a second replica, read both back into trees and audit them. One row a record:
    page_id, record_bytes and record_sha256 (of its uncompressed content as read from the first replica), damaged (the
    second differs from the first) and lost (the first differs from what was written). A loss in both replicas alike is lost
    and not damaged. ``damage``: see replicate()."""
    first, index = write_warc(pages)
    second = replicate(index, first, damage=damage)
    written, one, two = (Table(fixity_tree(index, folder), "tree").df for folder in (None, first, second))
    bad = audit(one, two).select("file", "node", F.lit(True).alias("damaged"))
    lost = audit(written, one).select("file", "node", F.lit(True).alias("lost"))
    records = one.where("level = 0").join(bad, ["file", "node"], "left").join(lost, ["file", "node"], "left")
    return records.select("page_id", "record_bytes", "record_sha256", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("damaged", "lost")))
