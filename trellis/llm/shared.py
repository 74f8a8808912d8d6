"""What the corpus operators share: the shared folder, written tables, file access from tasks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to a Python worker, where bound_batches() is asked for.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder takes its place
    on one machine (a local master, as in tests); a cluster is refused, since its machines share no such folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="trellis-")
        root = _OWN_DIR[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; what lies there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/trellis/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


class Table:
    """A DataFrame written as Parquet below the shared folder: lineage ends here, and a lost executor costs nothing.
    ``files`` is how many files its known size deserves; without it each partition makes one."""

    def __init__(self, df: DataFrame, label: str, files: int | None = None):
        self.spark, self.path, self.schema = df.sparkSession, new_path(df.sparkSession, label), df.schema
        (df.coalesce(files) if files else df).write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, label: str) -> DataFrame:
    return Table(df, label).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column, n: int):
    """crc32 of a column's text form, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """write(stream) into a file that appears under its name only when complete; a repeated task replaces it."""
    fs, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def slices(table_or_batch, column: str, limit: int = 4 << 20):
    """Row slices whose text column has about limit bytes at most; one longer text makes a slice of its own."""
    import numpy as np

    arr = table_or_batch.column(column)
    n = len(arr)
    if not n:
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield table_or_batch.slice(lo, hi - lo)
        lo = hi
    release()


def release() -> None:
    """Give memory that was freed back to the system: workers live on from task to task, and share the executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it, and only glibc keeps so much
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to this session's Python workers in batches of about BATCH_BYTES (a row of more is a batch by itself),
    unless the session has a limit of its own. Spark's is 64 MB or 10,000 rows; the executor and its workers hold each
    batch several times at once, as buffers that double, as bytes that are sent and as the worker's table."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed; once an application."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="trellis-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = os.path.join(folder, "trellis.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for inner, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(inner, name)
                    z.write(path, os.path.join(os.path.basename(top), os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(to)
