"""Shared folders, staged tables, and Arrow helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Uncompressed text that one task of a Python stage works through.
TASK_BYTES = 24 << 20
#: Bytes of one Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A join treats this many keys at most as hot, and none with fewer rows than HOT_ROWS.
HOT_KEYS, HOT_ROWS = 1000, 1000

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local session (tests) uses a temporary folder, and any
    other session a folder beside the warehouse, never a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        if not _local_root:
            _local_root.append("file://" + tempfile.mkdtemp(prefix="kinweave-"))
        return _local_root[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinweave_scratch"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what it no longer refers to; executors then delete the shuffle files of finished jobs, which
    loops of many small jobs would otherwise pile up until the driver happens to need memory."""
    spark._jvm.System.gc()


def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes batches on; its Python worker first returns what it has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
    yield from batches


def give_back(spark: SparkSession, workers: bool = True) -> None:
    """Executors and their Python workers return memory that finished jobs left.

    A heap that grew stays that large until a collection happens to shrink it, and workers live as long as the session, so
    the peaks of stages that follow each other add up. One small task a core collects. A local session has the driver's
    heap only. ``workers``: whether there are Python workers.
    """
    release(spark)
    if spark.sparkContext.master.split("[")[0] == "local":
        return
    cores = spark.sparkContext.defaultParallelism
    collect = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    tasks = spark.range(0, cores, 1, cores)
    (tasks.mapInArrow(trim, "id long") if workers else tasks).select("id", collect.alias("done")).collect()


class Scratch:
    """Tables of one run of an operator, written to the shared folder.

    A written table cuts lineage, so a lost executor costs only the tasks that were running. ``drop`` removes a table
    once nothing lazy reads it; what is left goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/kinweave/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # the session may be gone already
            pass

    def at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        # no marker file: local file systems start a process for every file and folder that they make
        out = df.write.mode("overwrite").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        out.parquet(self.at(table))
        return self.spark.read.schema(df.schema).parquet(self.at(table))

    def load(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.at(table))

    def drop(self, *tables: str) -> None:
        for t in tables:
            _delete(self.spark, self.at(t))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column, which sizes partitions."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0])


def partitions(spark: SparkSession, total_bytes: int, each: int = TASK_BYTES) -> int:
    """As many partitions as keep each under ``each`` bytes, and no fewer than there are cores to use."""
    return max(spark.sparkContext.defaultParallelism, -(-total_bytes // each), 1)


def narrow(df: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so extra columns can't clash."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return df.select(*cols, *[F.col(f"`{c}`").alias(n) for n, c in more.items()])


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``limit`` bytes of text, one whole row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Within it, Arrow batches that go to Python hold about ``size`` bytes, however long their rows are."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal leading ``keys`` columns, of batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.zeros(n, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            cut[0] = any(last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in range(keys))
        edges = [*np.flatnonzero(cut).tolist(), n]
        at = 0
        for to in edges:
            if to > at:
                held.append(batch.slice(at, to - at))
                at = to
            if to < n and held:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """An equi-join whose hot keys don't meet in one task.

    ``right`` has one row per key, with the number of ``left`` rows of that key in column ``rows`` (dropped). Keys that
    hold more than a thousandth of all rows are a thousand at most, by arithmetic, so their rows are broadcast.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    limit = max(least, int(total) // HOT_KEYS)
    hot = right.where(F.col(rows) > limit).drop(rows)
    if hot.isEmpty():
        return left.join(right.drop(rows), on, how)
    cold = right.where(F.col(rows) <= limit).drop(rows)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def ranges(df: DataFrame, id_col: str, n: int, each: int = 20) -> np.ndarray:
    """At most ``n`` ascending ids that start ranges of about as many rows each; each is an id of the table.

    A sample of about ``each`` ids a range comes to the driver, however many rows there are.
    """
    low, count = df.agg(F.min(id_col), F.count(id_col)).first()
    if low is None:
        return np.zeros(0, np.int64)
    share = n * each / count
    ids = df.select(id_col) if share >= 1 else df.select(id_col).sample(share, seed=17)
    got = np.sort(ids.where(F.col(id_col).isNotNull()).toPandas()[id_col].to_numpy(np.int64))
    picked = got[(np.arange(n) * len(got)) // n] if len(got) else got
    return np.unique(np.append(picked, np.int64(low)))[:n] if n > 1 else np.array([low], np.int64)


def place(spark: SparkSession, id_col: str, starts: np.ndarray) -> Column:
    """Twice the index of the range that an id falls into, and one more if the id begins it.

    The starts are broadcast as an array, so the plan stays small; only ids go through Python.
    """
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def spot(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, ids.to_numpy(np.int64), "right") - 1
        return pd.Series(2 * at + (shared.value[at] == ids.to_numpy(np.int64)))

    return spot(F.col(id_col))
