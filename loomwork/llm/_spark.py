"""What the operators share: tables, tables written to cut lineage, and batches of bounded size."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # of text that a Python worker handles at once; a longer single text is still whole
TRIM_BYTES = 8 << 20  # of text after which a worker returns what it has freed to the system

_handled = 0


def give_back_memory() -> None:
    """Return freed memory to the system, where the C library can; a worker that waits has no use for it."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that goes to Python, unless the session does so itself: 10,000 long texts are more than a worker should hold."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only where it is unset and all runs on one machine, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomwork-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost executor loses nothing."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, whose ``column`` holds about ``limit`` bytes at most, or a single longer row."""
    global _handled
    sizes = batch.column(batch.schema.get_field_index(column))
    lengths = pc.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
    _handled += int(total[-1])
    if _handled >= TRIM_BYTES:
        _handled = 0
        give_back_memory()


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text as bytes, null as empty, under names that no other column can clash with."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
