"""Bitmaps of a fixed size, filled by tasks and sent to all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import shuffle_partitions

BLOCK_BITS = 19


def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """Bits 0 to 2 ** bits - 1, set at the positions (column at). Tasks fill blocks of 64 KB; the driver gets the blocks."""
    blocks = 1 << max(0, bits - BLOCK_BITS)
    rows = positions.select(F.shiftright("at", BLOCK_BITS).alias("block"), F.col("at").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("bit"))
    parts = min(blocks, shuffle_partitions(positions.sparkSession))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            block, bit = (b.column(c).to_numpy() for c in ("block", "bit"))
            for k in np.unique(block).tolist():
                held.setdefault(k, np.zeros(1 << BLOCK_BITS, bool))[bit[block == k]] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros(blocks << (BLOCK_BITS - 3), np.uint8)
    for r in rows.repartition(parts, "block").mapInArrow(fill, "block bigint, bits binary").toLocalIterator():
        at = r.block << (BLOCK_BITS - 3)
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def is_set(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marked[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
