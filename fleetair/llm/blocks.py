"""Corpus-wide counts for documents that are read in blocks.

A block is a run of documents with a dictionary of its own. What a block holds is
named by 64-bit keys that are spread evenly. Each block sends every distinct key once,
with its count, to the bucket of the key, a range of keys; a bucket adds the counts of
all blocks and sends each block its totals in the order the block had them. A key that
holds a third of the corpus is one entry per block like any other, and totals travel
as arrays of small numbers.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from fleetair.plans.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries that a bucket holds, about.
BUCKET_ENTRIES = 1 << 18
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 22

#: The characters [\x20\x09-\x0D], at which bytes.split() cuts as well.
SPACE = b" \t\n\v\f\r"


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, so that one of any length needs bounded memory."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def numbering() -> defaultdict:
    """A dictionary that numbers what it is asked for, from 0, in the order of asking."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def halves(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as their low and high 16 bits. The high ones are mostly 0 and pack to nothing."""
    return (numbers & 0xFFFF).astype(np.uint16).view(np.int16), (numbers >> 16).astype(np.int16)


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.astype(np.int32) << 16 | low.view(np.uint16)


def give_back() -> None:
    """Return what a worker has freed to the system: it lives on after a task, and keeps it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def block_ids() -> Iterator[int]:
    """Numbers that no other task of the job gives."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


#: Rows that Python gets at a time: texts, and rows of blocks.
TEXTS_AT_ONCE, BLOCKS_AT_ONCE = 512, 4
_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, at_once: int = BLOCKS_AT_ONCE, rows_per_file: int = 0) -> DataFrame:
    """Write a table of large arrays to the shared scratch folder and read it again.

    While it is made Python gets ``at_once`` rows at a time. Files have few rows, since a reader
    takes a file's rows together.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_AT_ONCE)
    spark.conf.set(_AT_ONCE, at_once)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        spark.conf.set(_AT_ONCE, before)
    return spark.read.schema(df.schema).parquet(path)


def totals(
    blocks: DataFrame, entries: Callable[[dict], tuple[np.ndarray, np.ndarray]], buckets: int,
    summary: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """``block, bucket, total, kept, ids, vals``: what each block's keys count in all blocks.

    ``entries`` takes a row of ``blocks`` as a dictionary of Arrow scalars and gives the block's distinct keys,
    unsigned and ascending, with their counts. ``kept`` leaves out the blocks whose column
    ``deleted`` is true, and is sent to those alone. ``summary`` takes a bucket's distinct
    keys and totals and gives numbers that come with one row of the bucket, as ``ids, vals``.
    """
    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                keys, n = entries(row)
                of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                used, start = np.unique(of, return_index=True)
                offsets = pa.array(np.append(start, len(keys)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int64)),
                    pa.array([row["block"].as_py()] * len(used), pa.int64()),
                    pa.array([row["deleted"].as_py()] * len(used), pa.bool_()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64))),
                ], ["bucket", "block", "deleted", "keys", "n"])
        give_back()

    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, n = (table[c].combine_chunks() for c in ("keys", "n"))
        sizes = keys.value_lengths().to_numpy()
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        distinct, where = np.unique(keys.flatten().to_numpy().view(np.uint64), return_inverse=True)
        count = n.flatten().to_numpy()
        total = np.bincount(where, weights=count).astype(np.int64)
        deleted = table["deleted"].to_numpy().astype(bool)
        kept = np.bincount(where, weights=np.where(np.repeat(deleted, sizes), 0, count)).astype(np.int64)
        ids, vals = summary(distinct, total)
        rest = [None] * (table.num_rows - 1)
        kept_lists = pa.ListArray.from_arrays(offsets, pa.array(kept[where]))
        return pa.table({
            "block": table["block"], "bucket": table["bucket"],
            "total": pa.ListArray.from_arrays(offsets, pa.array(total[where])),
            "kept": pc.if_else(pa.array(deleted), kept_lists, pa.scalar(None, kept_lists.type)),
            "ids": pa.array([ids.tolist(), *rest], pa.list_(pa.int64())),
            "vals": pa.array([vals.tolist(), *rest], pa.list_(pa.int64())),
        })

    sent = blocks.mapInArrow(spread, "bucket long, block long, deleted boolean, keys array<long>, n array<long>")
    return sent.groupBy("bucket").applyInArrow(
        add, "block long, bucket long, total array<long>, kept array<long>, ids array<long>, vals array<long>")


def in_order(counts: pa.Table, column: str) -> np.ndarray:
    """A block's totals in the order of its keys."""
    counts = counts.sort_by("bucket")
    return counts[column].combine_chunks().flatten().to_numpy()
