"""What several corpus operators share: stable storage, components, distributed ranks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import components, stable, written

__all__ = ["among", "bitmap", "bounded_batches", "components", "freed", "lean", "partitions", "running", "sorted_groups", "stable", "table", "tokenizer_path", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder sf_dir, as any Spark reader sees it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Lets Arrow batches end by size, so that a worker's memory does not follow the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow, which gives its memory back to the system at the end of a task: an idle worker holds none."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, group: list[str], order: list[str], size: str, out: str, fan: int = 1024) -> DataFrame:
    """df with `out`: the sum of `size` over the rows of the group that come before.

    Rows of a group are dealt to `fan` slices by a hash of the order columns, summed in
    each slice, and shifted by the slices before: no group, however large, meets in one
    task, and the order is total wherever `order` is. Slices follow the hash, so the order
    inside a group is (hash, order), a fixed shuffle of the group. Group columns hold no nulls.
    """
    keys = [*group, "__run_slice"]
    dealt = df.withColumn("__run_slice", F.pmod(F.xxhash64(*order), F.lit(fan)))
    before = Window.partitionBy(*group).orderBy("__run_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*keys).agg(F.sum(size).alias("__run_sum")).select(*keys, F.coalesce(F.sum("__run_sum").over(before), F.lit(0)).alias("__run_shift"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.withColumn("__run_part", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return part.join(shift, keys).withColumn(out, F.col("__run_part") + F.col("__run_shift")).drop("__run_slice", "__run_part", "__run_shift")


def bitmap(ids: DataFrame, column: str, most: int = 1 << 29) -> bytes:
    """A filter of the 64-bit hashes in `column`: bit pmod(hash, bits) is set for every one.

    16 bits for each row of ids, but `most` at most (64 MB, whatever the input); beyond, it only
    drops less. It lets a scan drop most rows that a later exact join would drop, and never
    one that the join needs.
    """
    bits = min(most, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = ids.select((slot / 32768).cast("long").alias("k"), F.pmod(slot, F.lit(32768)).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    out = bytearray(bits // 8)
    for k, b in rows:
        out[k * 4096 : k * 4096 + 4096] = b
    return bytes(out)


def among(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    mask = np.frombuffer(bits, np.uint8)
    slot = hashes % (len(mask) * 8)
    return (mask[slot >> 3] >> (slot & 7)) & 1 == 1


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of equal first column in batches that are sorted by it, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(key):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of frames that nothing refers to any more.

    They otherwise stay until the driver's JVM happens to collect its garbage, which on a large heap is long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return str(Path("/opt/tokenizers") / name)
