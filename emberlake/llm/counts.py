"""Count vectors and bit sets of fixed length, added up over all partitions in Spark.

A vector is cut into pieces of ``PIECE`` counts; each task sends one row for each
piece, rows are dealt by piece and added as they stream by, so no task holds more
than its pieces and the driver gets one vector, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.shared import small_batches

PIECE = 4096
_SCHEMA = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])


def _rows(pieces: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k in pieces:
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pieces[k].astype("<i8").tobytes()], pa.binary())], schema=_SCHEMA)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(raw.as_buffer(), "<i8")
            total[k] = total[k] + part if k in total else part
    yield from _rows(total)


def count_vector(df: DataFrame, length: int, count: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of what ``count(batch, vector)`` adds to a vector of ``length``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, some = np.zeros(length, np.int64), False
        for batch in batches:
            count(batch, vector)
            some = True
        if some:
            yield from _rows({k: vector[k * PIECE : (k + 1) * PIECE] for k in range(-(-length // PIECE))})

    kind = "piece int, counts binary"
    out = np.zeros(length, np.int64)
    with small_batches(df.sparkSession):
        rows = df.mapInArrow(local, kind).repartition("piece").mapInArrow(_add, kind).collect()
    for row in rows:
        part = np.frombuffer(row["counts"], "<i8")
        out[row["piece"] * PIECE : row["piece"] * PIECE + len(part)] += part
    return out


def cells_of(values: np.ndarray, cells: int) -> np.ndarray:
    """The cell, of ``cells`` (a power of two), of 64-bit hashes: their first bits."""
    return (values.view(np.uint64) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def bit_set(hashes: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell, set where a value of the one long column falls; packed, the first bit lowest."""
    cell = F.call_function("shiftrightunsigned", F.col(hashes.columns[0]), F.lit(65 - cells.bit_length()))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(F.call_function("shiftright", cell, F.lit(6)).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # cells / 64 rows at most
    out = np.zeros(cells // 64, "<i8")
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, bitorder="little").view(bool)
