"""Helpers that the training-data operators share.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir`` so that every executor and the driver can
read them and no lost executor takes them away.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of the text passes: at most so many bytes and rows (see small_batches).
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
#: Rows that a Parquet reader decodes at a time.
READER_ROWS = 512
#: A table of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Text bytes that one numpy pass works on.
CHUNK_BYTES = 1 << 20
_BLOCK = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master a temporary one is set where it is unset.

    A cluster without that setting is refused: its executors share no temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="paneflow-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Workspace:
    """A folder of one run below :func:`shared_dir` with its written tables."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage is cut, and the table survives executors."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder for flat files, made."""
        fs, path = pafs.FileSystem.from_uri(f"{self.path}/{name}")
        fs.create_dir(path, recursive=True)
        return f"{self.path}/{name}"

    def drop(self, *names: str) -> None:
        """Delete tables or folders that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def as_struct(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that their names clash with nothing."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES and BATCH_ROWS and its Parquet batches to READER_ROWS where they are larger, and leave it so.

    What the operators return runs later, under the settings of that time; a batch of
    64 MB, Spark's default, is held several times by each task and its Python worker.
    A Parquet reader holds the texts of a batch as one array and doubles it as it grows:
    with Spark's 4,096 rows tens of MB in each task, on the heap.
    """
    prefix = "spark.sql.execution.arrow."
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(prefix + "maxBytesPerBatch"))
    if held not in range(1, BATCH_BYTES + 1):
        spark.conf.set(prefix + "maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get(prefix + "maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(prefix + "maxRecordsPerBatch", str(BATCH_ROWS))
    reader = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(reader)) > READER_ROWS:
        spark.conf.set(reader, str(READER_ROWS))


@contextlib.contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]):
    """Session settings for the actions inside; the old ones come back."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Join a written table ``right``: broadcast if it has at most ``limit`` rows (counted unless ``rows`` says it), else shuffled.

    The shuffled way leaves both exchanges directly below the join, so that
    adaptive execution can split a key that holds much of ``left``.
    """
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= limit else right.hint("merge"), on, how)


@cache
def _trim():
    """The C library's malloc_trim, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, beside=0):
    """Row ranges of a batch with about ``limit`` bytes of text: (first, last, strings), null as empty.

    ``beside`` counts the bytes that each row brings besides its text.
    """
    texts = pc.fill_null(batch.column(column), "")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False) + beside
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield first, i, texts.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < len(texts):
        yield first, len(texts), texts.slice(first)
    give_back()


def slot_counts(rows: DataFrame, slots_of, bits: int) -> np.ndarray:
    """How often each of 2**``bits`` slots occurs, up to 255: a fixed number of bytes, whatever the rows are.

    ``slots_of`` gives the slots of one Arrow batch, as arrays one after the other. Tasks count apart and
    send their counts in blocks, which are added up before they reach the driver.
    """

    def count(batches):
        held = np.zeros(1 << bits, dtype=np.uint8)
        for batch in batches:
            for found in slots_of(batch):
                at, times = np.unique(found, return_counts=True)
                held[at] = np.minimum(held[at] + times, 255)
        for k, block in enumerate(held.reshape(-1, _BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "held": [zlib.compress(block.tobytes(), 1)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, held in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), strict=True):
                sums[k] = np.minimum(sums.get(k, 0) + np.frombuffer(zlib.decompress(held), dtype=np.uint8).astype(np.int64), 255)
        for k, total in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "held": [zlib.compress(total.astype(np.uint8).tobytes(), 1)]})

    schema = "block int, held binary"
    out = np.zeros((1 << bits) // _BLOCK * _BLOCK, dtype=np.uint8).reshape(-1, _BLOCK)
    for k, held in rows.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[k] = np.frombuffer(zlib.decompress(held), dtype=np.uint8)
    return out.reshape(-1)
