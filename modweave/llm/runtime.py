"""Session-level helpers shared by the corpus operators: shared storage, Arrow columns, bitmaps."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A chunk of texts that one vectorised step handles at a time; a longer text forms a chunk of its own.
CHUNK_BYTES = 2 << 20
# Most bits of the broadcast bitmaps that thin out candidates: 2**28 bits are 32 MB, whatever the input.
BITMAP_BITS = 28
# Rows of one key beyond which a join does not send them to one task; there are at most rows / FREQUENT such keys.
FREQUENT = 1 << 18
# Bytes of an Arrow batch where executors have little memory: each task's JVM holds a batch, and twice that while it grows.
BATCH_BYTES = 8 << 20
_BUCKET_BITS = 32768  # bits in one value of bitmap_construct_agg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; one of our own only where that is unset and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that lost executors cost nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same for wide rows, as a Parquet table, which takes less room than a checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle and checkpoint files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches of the session have ``most`` bytes; a smaller bound that it has already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def give_back() -> None:
    """Return what is free in this process to the system: Arrow's pool, and the C library's heap where it can be trimmed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one array of UTF-8 bytes and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype="<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "<i8")
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay within ``limit`` bytes, or one longer row. What they took is given back after the last one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
    give_back()


def join_frequent(rows: DataFrame, table: DataFrame, on: str, size: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per value of ``on`` and, in ``size``, how many of ``rows`` have it.

    Values of more than ``FREQUENT`` rows are broadcast, of which there are at most rows / FREQUENT, so that no value's rows
    meet in one task. ``table`` is read twice: cut it before.
    """
    often = table.where(F.col(size) > FREQUENT)
    if not often.limit(1).count():
        return rows.join(table, on)
    often = F.broadcast(often)
    rest = rows.join(often.select(on), on, "left_anti")
    return rows.join(often, on).unionByName(rest.join(table.where(F.col(size) <= FREQUENT), on))


def bitmap_of(keys: Column, df: DataFrame, n: int | None = None) -> np.ndarray:
    """Which of 2**bits slots the 64-bit ``keys`` (their top bits) of ``df`` touch, as bytes of ones and zeros in bit order.

    There are 16 slots and more for each of ``n`` keys (the rows of ``df``, counted where not given) up to 2**BITMAP_BITS.
    Built by a native aggregate; the driver receives one bit per slot at most. A full bitmap lets all candidates pass: it
    costs time, not results.
    """
    n = df.count() if n is None else n
    bits = min(BITMAP_BITS, max(15, (16 * max(1, n) - 1).bit_length()))
    slot = F.shiftrightunsigned(keys, 64 - bits)
    found = (
        df.select(slot.alias("slot"))
        .groupBy(F.expr(f"slot div {_BUCKET_BITS}").alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(slot % {_BUCKET_BITS})").alias("bitmap"))
        .collect()
    )
    out = np.zeros(max(1, (1 << bits) // _BUCKET_BITS) * (_BUCKET_BITS // 8), np.uint8)
    width = _BUCKET_BITS // 8
    for r in found:
        out[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the slots of the unsigned ``keys`` are set."""
    bits = int(len(bitmap) * 8).bit_length() - 1
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def as_long(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))
